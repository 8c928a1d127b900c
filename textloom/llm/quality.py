"""Per-document text quality statistics, outlier scores and text classes.

Each text gets statistics and a language by its common words. Texts that can only be prose
by their lines are the reference of their language: the exact ranks of the reference's
statistics come from a range-partitioned sort of their distinct values, with partition
offsets, and tell every text's tail probabilities, on the side that speaks against prose.
The tails of the statistics that a class is known by add to a score for that class, as in
empirical-cumulative outlier detection; a text's outlier score is the highest of them. As
only prose is ranked, and each distinct text once, no score depends on how common lists,
tables, junk or copies of them are.

Lines come in three sorts: sure ones, that are a list's, a table's or junk whatever stands
around them; doubtful ones, such as short lines without a sign, that a poem has as well as
a list; and prose. A text with more than half of it in sure lines is a case. One that needs
its doubtful lines for that is a case if it is an outlier, with a score that at most one in
OUTLIER_RATE of the reference has. Where two classes have nearly as much of a text, their scores decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tables import filled
from textloom.session import Workspace

# Common words by language.
COMMON = {
    "de": "der die das den dem des ein eine einen einem einer und oder aber es er sie ich wir man nicht kein so auch wer was wie war ist wird sind hat bei aus auf an am im in mit von zu zum zur vor nach über zwischen ob weil dass jedoch niemand warum",
    "en": "the a an that this of to and or but it he she they i we not no is was are there between with from by in on at about who whoever why because since so until whenever nobody although also never as",
    "fr": "le la les un une des du de et ou mais ce c l d il elle ils on nous ne pas que qui est dit avec pour par dans en sur pourquoi parce alors comme sans",
    "es": "el la los las un una de del y o pero es lo él ella se no que quien con por para en sobre porque cuando como sin junto dicen al a su",
}
LANGUAGES = tuple(COMMON)
_LANGUAGES_OF = {w: tuple(i for i, l in enumerate(LANGUAGES) if w in COMMON[l].split()) for l in LANGUAGES for w in COMMON[l].split()}

#: Statistics, the tail that speaks against prose, and the classes that it speaks for.
STATISTICS = {
    "mean_word_chars": ("both", ("junk",)),
    "symbol_ratio": ("high", ("table", "junk")),
    "digit_ratio": ("high", ("table",)),
    "ended_lines": ("low", ("list", "table")),
    "common_words": ("low", ("list", "table", "junk")),
    "single_characters": ("high", ("junk",)),
    "repeated_sentences": ("high", ("junk",)),
    "words_per_line": ("low", ("list", "table")),
    "sentences_per_word": ("low", ("list", "junk")),
}
CLASSES = ("list", "table", "junk")
#: At most one in so many of the reference's texts counts as an outlier.
OUTLIER_RATE = 20
#: Two classes with shares no further apart are told apart by their scores.
NEARLY = 0.1
#: With a lower share of common words a text has no language.
LEAST_COMMON = 0.1
#: Values that a 256th of a language's texts share are looked up in a table sent to every task; there are at most 256 by statistic.
HOT = 256

WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"\d+")
SIGN = re.compile(r"[^\w\s]|_")
#: Characters that a sentence ends with.
STOPS = frozenset(".!?…\"'»“”’)]")
ENDS = frozenset(".!?…;:")
MARK = re.compile(r"(?:[-–—*•·>+]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(?[A-Za-z]{1,2}\))\s+\S")
LEADERS = re.compile(r"\.{4,}\s*\d+$|(?:\. ){4,}\s*\d+$")
ENTRY = re.compile(r"[^\s:]+(?: [^\s:]+)?: \S")
LINK = re.compile(r"(?:https?://|www\.)\S+$")
RULE = re.compile(r"[-=+|_: ]{3,}$")
COLUMNS = re.compile(r"\S {2,}\S")
CSS = re.compile(r"\{[^{}]*:[^{}]*\}|^[^{}]*\{[^{}]*:[^{}]*$|;\s*\}")
MENU = re.compile(r"<<|>>|\^ \S+ \S+ \^|\| > |\| [^|]*\w > \w+$|weiter >|< zurück")
HEX = re.compile(r"(?:[0-9a-f]{2}|[0-9a-f]{4}|[0-9a-f]{8}:?)$", re.I)
CODE = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])(?:[\w]+(?:[-_:.]+[\w]+)+|[A-Za-z]+\d{3,}\w*|\d+[a-z]+\d\w*)$")
BROKEN = re.compile(r"[�¤¶]|[ÃÂ][\u0080-¿¤¶]|Ã|â€|(?<=[^\W\d_])[?#](?=[^\W\d_])|(?<=\S)#|#(?=\S#)")


#: Without these a line isn't broken.
BROKEN_SIGNS = re.compile("[\ufffd¤¶ÃÂâ?#]")
#: Signs without which a line of words that ends like a sentence is prose.
UNUSUAL = re.compile("[{}<>^\t|\ufffd¤¶ÃÂ#]")
UNUSUAL_RUNS = ("â€", "....", ". . . .")
ASKED = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
QUOTES = "\"'»“”’)]"
NUMBERED = re.compile(r"\(?\d{1,4}[.)]\s")
SEPARATORS = (" · ", " / ", ", ", " • ", "; ")


def _single(token: str) -> bool:
    return len(token) <= 2 and sum(map(str.isalpha, token)) <= 1


def ends_sentence(s: str) -> bool:
    """Full stops or the like at the end, quotes and brackets aside, that don't follow a number or dots; or one sign behind a digit."""
    bare = s.rstrip(QUOTES)
    if bare[-1:] not in STOPS or bare[-1:] in QUOTES or not bare:
        return False
    front = bare.rstrip(".!?…")
    if not front[-1:].isdigit():
        return True
    signs = bare[len(front) :]
    return any(c != "." for c in signs[:-1]) or s[-1] in ".!?" and s[-2:-1].isdigit()


class Line:
    """A line's class, whether that is doubtful by itself, and what the statistics add up."""

    __slots__ = ("bare", "kind", "doubtful", "tokens", "words", "letters", "visible", "common", "votes", "singles", "ended", "stops", "alone")

    def __init__(self, line: str):
        self.bare = bare = line.strip()
        self.tokens = tokens = bare.split()
        words = WORD.findall(bare.lower())
        self.words = len(words)
        self.letters = len("".join(words))
        self.visible = len("".join(tokens))
        self.votes = [_LANGUAGES_OF[w] for w in words if w in _LANGUAGES_OF]
        self.common = len(self.votes)
        self.singles = sum(map(_single, [t for t in tokens if len(t) <= 2]))
        self.ended = bare.rstrip(QUOTES)[-1:] in ENDS
        self.stops = sum(map(ends_sentence, [t for t in tokens if t[-1] in STOPS]))
        kind = self._kind(line)
        self.doubtful = kind[-1] == "?"
        self.kind = kind.rstrip("?")
        self.alone = self.kind == "list" and len(tokens) <= 3 and not (MARK.match(bare) or LINK.match(bare) or LEADERS.search(bare) or ENTRY.match(bare))

    def _kind(self, line: str) -> str:
        """prose, list, table or junk; with a question mark where a line of prose might look the same."""
        bare, tokens, common, letters, visible = self.bare, self.tokens, self.common, self.letters, self.visible
        n = len(tokens)
        stop = bare[-1] in STOPS and ends_sentence(bare)
        if stop and common >= 2 and 4 * common >= n and visible >= 4 * n and 2 * letters > visible and bare.count(";") < 2 and not UNUSUAL.search(bare) and not any(r in bare for r in UNUSUAL_RUNS) and not ("?" in bare and ASKED.search(bare)) and not NUMBERED.match(bare):
            if max(map(len, tokens)) < 32:
                return "prose"
        longest = max(map(len, tokens))
        numbered = DIGIT.search(bare) is not None
        broken = len(BROKEN.findall(bare)) if letters < visible and BROKEN_SIGNS.search(bare) else 0
        if broken >= 2 and broken >= 0.04 * len(bare):
            return "junk"
        if ("{" in bare or "}" in bare) and CSS.search(bare) or ("<" in bare or ">" in bare or "^" in bare) and MENU.search(bare):
            return "junk"
        if n >= 4 and longest <= 9 and sum(bool(HEX.match(t)) for t in tokens) >= 0.9 * n:
            return "junk"
        if n >= 2 and numbered and sum(bool(CODE.match(t)) for t in tokens) >= 0.6 * n and "\t" not in line and ";" not in bare:
            return "junk"
        if longest >= 32 and any(len(t) >= 32 and "://" not in t and re.search(r"[A-Za-z]{2}", t) and not re.search(r"[;|,]|\.{3}|[a-zäöüß]{24}", t) for t in tokens):
            return "junk"
        if visible - letters >= 0.5 * visible:
            signs = SIGN.findall(bare)
            if len(signs) >= 0.5 * (letters + len(signs)) and len(set(signs)) >= 6:
                return "junk"
        if visible < 4 * n:
            rest = MARK.sub("", bare, count=1).split() if MARK.match(bare) else tokens
            if len(rest) >= 5 and sum(map(_single, rest)) >= 0.6 * len(rest) and not re.match(r"\|.*\|$|\|?[-:| ]+$", bare):
                return "junk"
        if LINK.match(bare):
            return "list"
        if RULE.match(bare):
            return "table"
        if "\t" in line.strip("\n"):
            return "table"
        if bare.count("|") >= 2 or (bare.count(";") >= 2 and n <= 2 * bare.count(";") + 3 and common <= n / 4):
            return "table"
        if LEADERS.search(bare):
            return "list"
        if stop and common >= 2 and not NUMBERED.match(bare):
            return "prose"
        if MARK.match(bare):
            return "list" if not stop or bare[-2:-1].isdigit() else "prose"
        if COLUMNS.search(bare) and common <= n / 5:
            return "table"
        if n >= 5 and 6 * common <= n and any(bare.count(s) >= 4 and n <= 2 * bare.count(s) + 4 for s in SEPARATORS):
            return "list?"
        if ENTRY.match(bare) and n <= 10 and not stop:
            return "list?"
        if n <= 3 and not common and not stop:
            return "list?"
        if n >= 4 and not common and letters and not stop and bare.lower() == bare:
            return "junk?"
        return "prose"


def line_class(line: str) -> str:
    """prose, list, table or junk, of a line that isn't blank, by itself."""
    return Line(line).kind


#: A sentence that comes so often, and makes so much of a text's sentences, comes over and over.
OVER = 4
LINES = re.compile("\r\n|[\n\r  \x0b\x0c\x85]")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def lines_of(text: str) -> list[Line]:
    """The lines that aren't blank; each distinct one is read once."""
    known: dict[str, Line] = {}
    out = []
    for line in LINES.split(text):
        found = known.get(line)
        if found is None:
            if not line or line.isspace():
                continue
            found = known[line] = Line(line)
        out.append(found)
    return out


def repeated(text: str, lines: list[Line]) -> int:
    """Characters in sentences, or in lines of prose, that come over and over, whichever are more."""
    sentences = SENTENCE.split(" ".join(text.split()))
    prose = [line.bare for line in lines if line.kind == "prose"]
    return max(_over(sentences, len(sentences)), _over(prose, len(lines)))


def _over(parts: list[str], n: int) -> int:
    if len(parts) < OVER or len(set(parts)) > len(parts) - OVER + 1:
        return 0
    return sum(len(s) * k for s, k in Counter(parts).items() if k >= OVER and 4 * k >= n and len(s) > 3)


def shares(text: str, lines: list[Line] | None = None, over: float | None = None) -> dict[str, float]:
    """Share of a text's characters by class, doubtful lines under ``list?`` and so on; the shares add up to one. A blank text has none."""
    lines = lines_of(text) if lines is None else lines
    if not lines:
        return {}
    chars: Counter = Counter()
    last = len(lines) - 1
    for i, line in enumerate(lines):
        kind, doubtful = line.kind, line.doubtful
        if line.alone or kind == "table" and RULE.match(line.bare):
            near = [lines[k].kind for k in (i - 1, i + 1) if 0 <= k <= last]
            if line.alone:  # a few words: the end of a wrapped sentence, unless their neighbours are entries too
                kind = "list" if "list" in near or not near else near[0] if len(set(near)) == 1 else "prose"
            else:
                kind = "table" if "table" in near else near[0] if near else "junk"
        chars[f"{kind}?" if doubtful and kind != "prose" else kind] += len(line.bare)
    total = sum(chars.values())
    over = min(repeated(text, lines) if over is None else over, chars["prose"])
    chars["prose"] -= over
    chars["junk"] += over
    return {k: c / total for k, c in chars.items() if c}


def statistics(text: str, lines: list[Line] | None = None, over: float | None = None) -> tuple[str, dict[str, float]]:
    """Language, und where hardly a common word occurs, and STATISTICS to four places."""
    lines = lines_of(text) if lines is None else lines
    words = sum(line.words for line in lines)
    tokens = sum(len(line.tokens) for line in lines)
    visible = sum(line.visible for line in lines) or 1
    common = sum(line.common for line in lines)
    votes = [0] * len(LANGUAGES)
    for line in lines:
        for of in line.votes:
            for i in of:
                votes[i] += 1
    language = LANGUAGES[max(range(len(votes)), key=lambda i: (votes[i], -i))] if common > LEAST_COMMON * words else "und"
    digits = sum(map(len, DIGITS.findall(text)))
    letters = sum(line.letters for line in lines)
    n, m = words or 1, len(lines) or 1
    values = {
        "mean_word_chars": letters / n,
        "symbol_ratio": max(0, visible - letters - digits) / visible if tokens else 0.0,
        "digit_ratio": digits / visible,
        "ended_lines": sum(line.ended for line in lines) / m,
        "common_words": common / n,
        "single_characters": sum(line.singles for line in lines) / (tokens or 1),
        "repeated_sentences": (repeated(text, lines) if over is None else over) / visible,
        "words_per_line": words / m,
        "sentences_per_word": sum(line.stops for line in lines) / n,
    }
    return language, {k: round(v, 4) for k, v in values.items()}


SHARES = ("prose", *CLASSES, *(f"{c}?" for c in CLASSES))
_SHARE_COLUMNS = ("prose", *CLASSES, *(f"maybe_{c}" for c in CLASSES))


def measure(items: DataFrame) -> DataFrame:
    """Columns source_id, text_hash, language, STATISTICS and the shares prose, list, table, junk, maybe_list, maybe_table and maybe_junk.

    Rows whose text is null or blank are left out.
    """
    names = [*STATISTICS, *_SHARE_COLUMNS]
    schema = "source_id long, text_hash long, language string, " + ", ".join(f"{n} double" for n in names)
    arrow = pa.schema([("source_id", pa.int64()), ("text_hash", pa.int64()), ("language", pa.string()), *((n, pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("text").dictionary_encode()
            got = []
            for text in codes.dictionary.to_pylist():
                lines = lines_of(text)
                over = repeated(text, lines)
                language, values = statistics(text, lines, over)
                part = shares(text, lines, over)
                got.append((language, [*values.values(), *(part.get(k, 0.0) for k in SHARES)]))
            take = codes.indices
            columns = [batch.column("source_id"), batch.column("text_hash"), pa.array([g[0] for g in got], pa.string()).take(take)]
            columns += [pa.array([g[1][k] for g in got], pa.float64()).take(take) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return items.where(filled("text") & F.col("source_id").isNotNull()).select("source_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def exact_ranks(values: DataFrame, ws: Workspace, partitions: int | None = None, name: str = "ranged") -> DataFrame:
    """For each (part, statistic, value): below and at_most, the weights of rows with a lower value and with none higher, n of the part.

    c and all are the numbers of rows with the value and of the part. Rows without a column
    weight weigh 1 each. The distinct values with their counts are sorted by ranges; each range
    adds up its own and gets the sum of the ranges before it as an offset, so that no task
    sees all values of a statistic, and equal values are one row however many there are.
    """
    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "statistic", "value"]
    weight = F.sum("weight") if "weight" in values.columns else F.count("*")
    counts = values.groupBy(*order).agg(F.count("*").alias("c"), weight.alias("w"))
    ranged = ws.put(counts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), name)
    here = Window.partitionBy("range", "part", "statistic").orderBy("value")
    running = ranged.withColumn("run", F.sum("w").over(here))
    sums = ranged.groupBy("part", "statistic", "range").agg(F.sum("w").alias("s"), F.sum("c").alias("k"))
    before, whole = Window.partitionBy("part", "statistic").orderBy("range"), Window.partitionBy("part", "statistic")
    offsets = sums.select("part", "statistic", "range", (F.sum("s").over(before) - F.col("s")).alias("offset"), F.sum("s").over(whole).alias("n"), F.sum("k").over(whole).alias("all"))
    return running.join(offsets, ["part", "statistic", "range"]).select(
        *order, "c", (F.col("offset") + F.col("run") - F.col("w")).alias("below"), (F.col("offset") + F.col("run")).alias("at_most"), "n", "all"
    )


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the table's columns; keys that many rows share are looked up in a small table sent to every task, the others in a join."""
    hot = F.broadcast(table.where("hot").drop("hot").withColumn("there", F.lit(True)))
    known = rows.join(hot, keys, "left")
    found = [c for c in table.columns if c not in (*keys, "hot")]
    return known.where("there").drop("there").unionByName(known.where("there is null").drop("there", *found).join(table.where("not hot").drop("hot"), keys))


def score(measured: DataFrame, ws: Workspace) -> DataFrame:
    """Adds list_score, table_score, junk_score, score (the highest of them) and outlier. Rows of one text_hash are one text.

    A class's score is the mean over its statistics of minus the logarithm of the share of the
    language's reference that lies as far out. outlier: at most one in OUTLIER_RATE of the
    reference has so high a score, or the text has no language.
    """
    statistics_ = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS)))
    weight = (F.col("prose") > 0.5).cast("int").alias("weight")
    texts = measured.dropDuplicates(["text_hash"])
    long = texts.select("text_hash", F.col("language").alias("part"), weight, statistics_.alias("x")).select("text_hash", "part", "weight", "x.statistic", "x.value")
    ranks = ws.put(exact_ranks(long, ws), "ranks")
    tails = {"low": -F.log((F.col("at_most") + 1) / (F.col("n") + 1)), "high": -F.log((F.col("n") - F.col("below") + 1) / (F.col("n") + 1))}
    side = F.create_map(*(F.lit(x) for s, (tail, _) in STATISTICS.items() for x in (s, tail)))[F.col("statistic")]
    tail = F.when(side == "low", tails["low"]).when(side == "high", tails["high"]).otherwise(F.greatest(*tails.values()))
    keys = ["part", "statistic", "value"]
    found = _looked_up(long, ranks.select(*keys, (F.col("c") * HOT >= F.col("all")).alias("hot"), tail.alias("tail")), keys)
    of = {c: [s for s, (_, classes) in STATISTICS.items() if c in classes] for c in CLASSES}
    scored = found.groupBy("text_hash", "part", "weight").agg(*(F.avg(F.when(F.col("statistic").isin(of[c]), F.col("tail"))).alias(f"{c}_score") for c in CLASSES))
    scored = ws.put(scored.withColumn("value", F.round(F.greatest(*(f"{c}_score" for c in CLASSES)), 6)).withColumn("statistic", F.lit("score")), "scores")
    places = exact_ranks(scored.select("part", "statistic", "value", "weight"), ws, name="places")
    # of no reference, nought texts have so high a score
    far = places.select(*keys, (F.col("c") * HOT >= F.col("all")).alias("hot"), ((F.col("n") - F.col("below")) * OUTLIER_RATE <= F.col("n")).alias("far"))
    out = _looked_up(scored, far, keys).select("text_hash", *(f"{c}_score" for c in CLASSES), F.col("value").alias("score"), (F.col("far") | (F.col("part") == "und")).alias("outlier"))
    return measured.join(out, "text_hash")


def classify(items: DataFrame) -> DataFrame:
    """Columns source_id, language, STATISTICS, shares by class, scores, outlier and text_class.

    ``items`` has source_id and text; a row delivered twice counts once, null and blank texts
    have no row. text_class is prose, or else the class with most of the text's characters; of
    classes with nearly as many the one of the highest score (of equals the first of CLASSES).
    """
    ws = Workspace(items.sparkSession, "quality")
    measured = ws.put(measure(items).distinct(), "measured")
    scored = score(measured, ws).drop("text_hash")
    sure = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    maybe = sum((F.col(f"maybe_{c}") for c in CLASSES[1:]), F.col(f"maybe_{CLASSES[0]}"))
    whole = {c: F.col(c) + F.col(f"maybe_{c}") for c in CLASSES}
    most = F.greatest(*whole.values())
    close = {c: F.when(share >= most - NEARLY, F.col(f"{c}_score")) for c, share in whole.items()}
    best = F.greatest(*close.values())
    kind = F.lit(CLASSES[-1])
    for c in reversed(CLASSES[:-1]):
        kind = F.when(close[c] == best, c).otherwise(kind)
    case = (sure > 0.5) | (F.col("outlier") & (sure + maybe > 0.5))
    return scored.withColumn("text_class", F.when(case, kind).otherwise("prose"))
