"""Visually identical text with different characters, brought to one form.

A text is affected where bringing it to that form changes it, and the step that does tells
how: the kinds come from the differences between the steps, not from a search beside them.
All of it works on values, the runs of characters between plain white space that hold any
character which isn't plain: each distinct value of the whole table goes through the steps
once, in Arrow batches, and the texts get their values' results by a join.

The form is compatibility-normalised and composed, fully case-folded, with every space
character mapped to the plain one, without default-ignorable characters and, in words
that mix scripts, with look-alike letters replaced by the Latin ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import Workspace

KINDS = ("combining", "fullwidth", "invisible", "lookalike", "space")

_PLAIN = r"\x21-\x7E¡-§©«¬®°±¶·»¿À-ÿ–—‘’‚“”„‹›€"
#: A text of these characters only has its form after lower-casing and ß to ss.
PLAIN = rf"^[ \t\n\r{_PLAIN}]*$"
#: A value: from white space to white space, with a character that isn't plain. Nothing is read twice, however long it is.
VALUE = rf"(?<![^ \t\n\r])[{_PLAIN}]*+[^ \t\n\r{_PLAIN}][^ \t\n\r]*+"
_VALUE = re.compile(VALUE)

FULLWIDTH = re.compile("[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a]")
SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
MARKED = re.compile(r"([^\W\d_])([\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+)")
#: Zero-width characters and soft hyphens; variation selectors only choose a picture's style.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000e0000-\U000e007f]")
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\uffff\U000e0000-\U000e0fff]")
_PICTURE = "[\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff]"
#: A joiner between two pictures belongs to the emoji.
JOINED = re.compile(f"(?<={_PICTURE})(?:[\ufe0f\U0001f3fb-\U0001f3ff])?\u200d(?={_PICTURE})|(?<=\ufe0f)\u200d(?={_PICTURE})|(?<=[\U0001f3fb-\U0001f3ff])\u200d(?={_PICTURE})")
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u05d0-\u05ea\u10a0-\u10ff\u13a0-\u13ff\u1c80-\u1c88\u1f00-\u1fff\u2c80-\u2cff\u2de0-\u2dff\ua640-\ua69f\uab70-\uabbf]")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")

# Cyrillic, Greek and Armenian letters that look like Latin ones, each before its Latin letter.
LOOKALIKES = {
    pair[0]: pair[1]
    for pair in (
        "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw вb кk мm нh тt "
        "АA ЕE ОO РP СC УY ХX ІI ЈJ ЅS ВB КK МM НH ТT ԚQ ԜW "
        "αa οo ιi νv ρp υu κk τt χx ϲc ϳj "
        "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
        "օo սu հh ցg յj ոn"
    ).split()
}


@lru_cache(maxsize=1 << 16)
def script(letter: str) -> str:
    """First word of the letter's name, of full-width ones the second; '' for signs that only look like letters."""
    name = unicodedata.name(letter, "").split(" ")
    if name[0] in ("FULLWIDTH", "HALFWIDTH"):
        name = name[1:]
    return "" if not name or name[0] in ("MICRO", "COMBINING", "FEMININE", "MASCULINE", "MODIFIER", "MATHEMATICAL", "OHM", "KELVIN", "ANGSTROM", "DOUBLE-STRUCK", "SCRIPT", "BLACK-LETTER", "SUPERSCRIPT", "SUBSCRIPT") else name[0]


def mixed(word: str) -> bool:
    found = {s for s in map(script, word) if s}
    return len(found) > 1 and "LATIN" in found


def kinds_of(text: str) -> list[str]:
    """Which of KINDS the steps to the one form change, sorted."""
    found = []
    shown = JOINED.sub("", text) if "\u200d" in text else text
    seen = INVISIBLE.sub("", shown)
    if seen != shown:
        found.append("invisible")
    seen = IGNORABLE.sub("", seen)
    composed = MARKED.sub(lambda m: unicodedata.normalize("NFC", m[0]), seen)
    if len(composed) < len(seen):
        found.append("combining")
    spaced = SPACES.sub(" ", composed)
    if spaced != composed:
        found.append("space")
    narrow = FULLWIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), spaced)
    if narrow != spaced:
        found.append("fullwidth")
    narrow = unicodedata.normalize("NFC", narrow)
    if FOREIGN.search(narrow) and any(map(mixed, WORD.findall(narrow))):
        found.append("lookalike")
    return sorted(found)


def _latin(m: re.Match) -> str:
    word = m[0]
    return "".join(LOOKALIKES.get(c, c) for c in word) if mixed(word) else word


def _step(text: str) -> str:
    t = unicodedata.normalize("NFC", IGNORABLE.sub("", text))
    if FOREIGN.search(t):
        t = WORD.sub(_latin, t)
    t = unicodedata.normalize("NFKC", SPACES.sub(" ", t)).casefold()
    return SPACES.sub(" ", IGNORABLE.sub("", unicodedata.normalize("NFKC", t)))


def one_form(text: str) -> str:
    """The form in which texts that look the same are equal; applying it again changes nothing."""
    while (t := _step(text)) != text:
        text = t
    return text


def text_items(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    return chapters.select(F.lit("chapters").alias("origin"), F.col("chapter_id").alias("item_id"), F.col("content").alias("text")).unionByName(
        sources.select(F.lit("source_documents").alias("origin"), F.col("source_id").alias("item_id"), "text")
    )


def _form(text: str, known: dict[str, str]) -> str:
    def value(m: re.Match) -> str:
        got = known.get(m[0])
        if got is None:
            got = known[m[0]] = one_form(m[0])
        return got

    return _VALUE.sub(value, text).casefold()


def affected(items: DataFrame) -> DataFrame:
    """Columns origin, item_id and char_kind, each once, of ``items`` (origin, item_id, text).

    Null, empty and blank texts, and texts of plain characters only, have no row. A value that
    many texts share is one row where it goes through the steps, and reduced with the others'
    before that; only values that a step changes are joined back.
    """
    ws = Workspace(items.sparkSession, "forms")
    some = items.where(~F.col("text").rlike(PLAIN)).select("origin", "item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(VALUE), 0))).alias("value"))
    held = ws.put(some, "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value")
            kinds = [kinds_of(v) for v in values.to_pylist()]
            yield pa.RecordBatch.from_arrays([values.cast(pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["value", "char_kinds"])

    changed = ws.put(held.select("value").distinct().mapInArrow(run, "value string, char_kinds array<string>").where(F.size("char_kinds") > 0), "changed")
    return held.join(changed, "value").select("origin", "item_id", F.explode("char_kinds").alias("char_kind")).distinct()


def normalise(items: DataFrame) -> DataFrame:
    """Columns origin, item_id, char_kinds (sorted array) and form.

    ``items`` has origin, item_id and text. A null text gives a null form and no kinds.
    Texts of plain characters get their form in the JVM; the others go to Python in Arrow
    batches, where each distinct value goes through the steps once a task.
    """
    base = items.select("origin", "item_id", "text")
    fields = [("origin", pa.string()), ("item_id", pa.int64()), ("char_kinds", pa.list_(pa.string())), ("form", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, str] = {}
        kinds: dict[str, list[str]] = {}
        for batch in batches:
            codes = batch.column("text").dictionary_encode()
            texts = codes.dictionary.to_pylist()
            own = []
            for t in texts:
                values = set(_VALUE.findall(t))
                for v in values - kinds.keys():
                    kinds[v] = kinds_of(v)
                own.append(sorted({k for v in values for k in kinds[v]}))
            columns = [batch.column("origin").cast(pa.string()), batch.column("item_id"), pa.array(own, pa.list_(pa.string())).take(codes.indices)]
            columns.append(pa.array([_form(t, forms) for t in texts], pa.string()).take(codes.indices))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
            if len(forms) > 1 << 17:  # a table of values in a task's memory stays small; what goes is made again
                forms, kinds = {}, {}

    plain = F.coalesce(F.col("text").rlike(PLAIN), F.lit(True))
    easy = base.where(plain).select("origin", "item_id", F.array().cast("array<string>").alias("char_kinds"), F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")).alias("form"))
    return base.where(~plain).mapInArrow(run, "origin string, item_id long, char_kinds array<string>, form string").unionByName(easy)
