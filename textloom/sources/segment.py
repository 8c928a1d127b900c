"""Cutting a document into chapters, and texts into overlapping chunks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.functions.text import SUFFIX

STRATEGIES = ("headings", "anchors", "numbers", "rules")
_HEADING = re.compile(r"^#\s+(.+)$", re.M)
_LINK = re.compile(r"\[([^\]]+)\]\(#([^)]+)\)")
_ANCHOR = re.compile(r"<a\s+(?:name|id)=[\"']([^\"']+)[\"']", re.I)
_RULE = re.compile(r"^\s*---\s*$", re.M)

Chapters = list[tuple[int, str, str]]


def _between(marks: list[tuple[int, int, str]], text: str) -> Chapters:
    """Chapters (index, title, body) that run from behind one mark (start, end, title) to the next."""
    stops = [m[0] for m in marks[1:]] + [len(text)]
    return [(k, title.strip(), text[end:stop].strip()) for k, ((_, end, title), stop) in enumerate(zip(marks, stops))]


def by_headings(text: str, least: int = 5) -> Chapters | None:
    found = [(m.start(), m.end(), m[1]) for m in _HEADING.finditer(text)]
    return _between(found, text) if len(found) >= least else None


def by_anchors(text: str, links: int = 20, least: int = 5, shortest: int = 20) -> Chapters | None:
    """Chapters at the anchors that a table of contents links to, in its order.

    An anchor named twice in the table counts once. A chapter ends at the first anchor
    behind it of the first later entry that has one; the index is that of the entry.
    """
    listed = _LINK.findall(text)
    if len(listed) < links:
        return None
    titles = {anchor: title for title, anchor in reversed(listed)}
    order = list(dict.fromkeys(anchor for _, anchor in listed))
    places: dict[str, list[tuple[int, int]]] = {}
    for m in _ANCHOR.finditer(text):
        places.setdefault(m[1].lower(), []).append((m.start(), m.end()))
    out: Chapters = []
    for k, anchor in enumerate(order):
        own = [p for p in places.get(anchor.lower(), []) if p[0] == 0 or text[p[0] - 1] not in "(]#"]
        if not own:
            continue
        start = own[0][1]
        later = (next((s for s, _ in places.get(a.lower(), []) if s > start), None) for a in order[k + 1 :])
        body = text[start : next((s for s in later if s is not None), len(text))].strip()
        if len(body) >= shortest:
            out.append((k, titles[anchor].strip()[:150], body))
    return out if len(out) >= least else None


def by_numbers(text: str, suffix: str = SUFFIX, least: int = 5) -> Chapters | None:
    pattern = re.compile(rf"^\d+\.\s+(.+\|[a-z]*{suffix}[a-z]*)$", re.M | re.I)
    found = [(m.start(), m.end(), m[1]) for m in pattern.finditer(text)]
    return _between(found, text) if len(found) >= least else None


def by_rules(text: str, least: int = 5, shortest: int = 50) -> Chapters | None:
    parts = _RULE.split(text)
    if len(parts) < least:
        return None
    kept = [(k, p.strip()) for k, p in enumerate(parts) if len(p.strip()) >= shortest]
    return [(k, p.split("\n")[0].strip()[:100], p) for k, p in kept] if len(kept) >= least else None


def segment_markdown(text: str, name: str, strategies: tuple[str, ...] = STRATEGIES, anchor_least: int = 5) -> tuple[Chapters, str]:
    """Chapters and the first strategy that gives enough of them; else the whole text as one.

    ``anchor_least=0`` takes whatever the anchors of a long table give, even nothing.
    """
    text = html.unescape(text)
    for strategy in strategies:
        if strategy == "anchors":
            got = by_anchors(text, least=anchor_least)
        else:
            got = {"headings": by_headings, "numbers": by_numbers, "rules": by_rules}[strategy](text)
        if got is not None:
            return got, strategy
    return [(0, f"(gesamt: {name})", text)], "monolith"


def chunk(text: str, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that will do, each
    beginning with up to ``overlap`` characters of whole parts of the one before."""
    separator = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(separator) + 1 :]
    parts = list(text) if separator == "" else text.split(separator)
    out: list[str] = []
    held: list[str] = []

    def length(ps: list[str]) -> int:
        return sum(map(len, ps)) + len(separator) * max(0, len(ps) - 1)

    def flush() -> None:
        joined = separator.join(held).strip()
        if joined:
            out.append(joined)

    for part in parts:
        if len(part) > size:
            if held:
                flush()
                held = []
            out.extend(chunk(part, size, overlap, finer or ("",)))
            continue
        if held and length([*held, part]) > size:
            flush()
            while held and (length(held) > overlap or length([*held, part]) > size):
                held = held[1:]
        held = [*held, part]
    if held:
        flush()
    return out


def _rows(df: DataFrame, key: str, text: str, schema: str, arrow: pa.Schema, make) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in make(k, t)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.where(f"{text} is not null").select(key, text).mapInArrow(run, schema)


def segments(df: DataFrame, name: str = "filename", text: str = "text", strategies: tuple[str, ...] = STRATEGIES, anchor_least: int = 5) -> DataFrame:
    """Rows source_file, strategy, chapter_index, title, content of Markdown documents; null texts give none."""
    schema = "source_file string, strategy string, chapter_index int, title string, content string"
    arrow = pa.schema([("source_file", pa.string()), ("strategy", pa.string()), ("chapter_index", pa.int32()), ("title", pa.string()), ("content", pa.string())])

    def make(key: str, value: str) -> list[dict]:
        got, strategy = segment_markdown(value, key, strategies, anchor_least)
        return [{"source_file": key, "strategy": strategy, "chapter_index": k, "title": t, "content": c} for k, t, c in got]

    return _rows(df, name, text, schema, arrow, make)


def chunks(df: DataFrame, name: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Rows id, text, source, chunk_index, total_chunks; the id is the source with a three-digit number."""
    schema = "id string, text string, source string, chunk_index int, total_chunks int"
    arrow = pa.schema([("id", pa.string()), ("text", pa.string()), ("source", pa.string()), ("chunk_index", pa.int32()), ("total_chunks", pa.int32())])

    def make(key: object, value: str) -> list[dict]:
        got = chunk(value, size, overlap)
        return [{"id": f"{key}_chunk{k:03d}", "text": c, "source": str(key), "chunk_index": k, "total_chunks": len(got)} for k, c in enumerate(got)]

    return _rows(df, name, text, schema, arrow, make)
