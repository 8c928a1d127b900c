"""Splitting oversized items at natural boundaries.

The fewest pieces that can hold the text give equally spaced targets; each target moves
to the strongest boundary near it. Where a piece then exceeds the limit, one more piece
is planned and the targets are placed anew. Beside this plan stand one that looks for
boundaries as far as the targets beside each target, and one with as many pieces as leave
a tenth of a piece on both sides of the targets; the plan with the fewest cuts off
boundaries is taken, of equals one with room around its targets, then the one of fewest pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200

#: Boundaries from the strongest to the weakest; a cut goes behind the match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t]*\n+(?=[#=]|\\(?:sub)*section|<h[1-6])",  # before a heading
        r"\n[ \t]*\n\s*",  # between paragraphs
        r"\n",
        r"[.!?…][\"'»“”’)\]]*\s+",
        r"[;:,–—]\s+",
        r"\s+",
    )
)


def _nearest(text: str, target: int, low: int, high: int) -> tuple[int, int]:
    """Place and strength of the strongest boundary in [low, high], the nearest of equals."""
    part = text[low:high]
    for level, pattern in enumerate(BOUNDARIES):
        ends = [low + m.end() for m in pattern.finditer(part)]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e)), len(BOUNDARIES) - level
    place = min(max(target, low), high)
    while low < place and not text[place : place + 1].isalnum() and ord(text[place : place + 1] or " ") > 0x2FF:
        place -= 1  # not between a character and the marks or joiners behind it
    return (place if place > low else target), 0


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces (start, end, overlap with the one before, strength of the boundary at the end).

    No piece is longer than ``limit``; together they cover the text, and each but the first
    begins about ``overlap`` characters before the end of the one before it. A text within
    the limit is one piece, an empty one too. The limit must exceed twice the overlap.
    """
    if limit <= 2 * overlap:
        raise ValueError("limit must exceed twice the overlap")
    size = len(text)
    if size <= limit:
        return [(0, size, 0, len(BOUNDARIES))]
    slack_back = overlap // 5
    room = limit - overlap - slack_back
    count = max(2, -(-(size - overlap) // (limit - overlap)))
    plans = [_plan(text, limit, overlap, count, False)]
    if BOUNDARIES[-1].search(text, 1):
        plans += [_plan(text, limit, overlap, n, True) for n in (count, max(count, math.ceil(size * 1.1 / room)))]

    def fault(pieces: list[tuple[int, int, int, int]]) -> tuple[int, bool, int]:
        bare = sum(not strength for *_, strength in pieces)
        return bare, not bare and size * 1.1 > room * len(pieces), len(pieces)

    return min(plans, key=fault)


def _plan(text: str, limit: int, overlap: int, count: int, far: bool) -> list[tuple[int, int, int, int]]:
    """Pieces for ``count`` targets, or as many more as the limit needs; far: look up to the next targets for a boundary."""
    size, slack_back = len(text), overlap // 5
    room = limit - overlap - slack_back
    while True:
        step = size / count
        radius = int(max(0, min((room - step), step / 3)))
        pieces, at, begin, back = [], 0, 0, 0
        for k in range(1, count + 1):
            if k == count:
                end, strength = size, len(BOUNDARIES)
            else:
                target = round(k * step)
                end, strength = _nearest(text, target, max(at + 1, target - radius), min(size - 1, target + radius)) if radius else (target, 0)
                if far and not strength:
                    low, high = max(at + 1, target - int(step) + 1), min(size - 1, begin + limit, target + int(step) - 1)
                    place, found = _nearest(text, target, low, high) if low < high else (end, 0)
                    end, strength = (place, found) if found else (end, 0)
            pieces.append((begin, end, back, strength))
            at = end
            begin = max(pieces[-1][0] + 1, end - overlap)
            if overlap:
                begin, _ = _nearest(text, end - overlap, max(pieces[-1][0] + 1, end - overlap - slack_back), max(pieces[-1][0] + 2, end - overlap + slack_back))
            back = end - begin
        if all(0 < e - s <= limit for s, e, _, _ in pieces):
            return pieces
        count += 1


def split_long(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of ``items`` (origin, item_id, chapter_index, content).

    Adds piece_no from 0, n_pieces, start and end (characters), overlap, strength and text.
    A content within the limit, empty or not, passes as one piece without leaving the JVM;
    a null one has no piece. Only longer ones go to Python. Rows are split one by one: an
    item that occurs twice is split twice.
    """
    columns = ["origin", "item_id", "chapter_index"]
    some = items.select(*columns, "content").where("content is not null")
    schema = "origin string, item_id long, chapter_index int, piece_no int, n_pieces int, start int, end int, overlap int, strength int, text string"
    arrow = pa.schema([("origin", pa.string()), ("item_id", pa.int64()), ("chapter_index", pa.int32()), *((c, pa.int32()) for c in ("piece_no", "n_pieces", "start", "end", "overlap", "strength")), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                pieces = cut(row["content"], limit, overlap)
                rows += [
                    {**{c: row[c] for c in columns}, "piece_no": k, "n_pieces": len(pieces), "start": s, "end": e, "overlap": o, "strength": w, "text": row["content"][s:e]}
                    for k, (s, e, o, w) in enumerate(pieces)
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    size = F.length("content")
    short = some.where(size <= limit).select(
        *columns, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), size.alias("end"), F.lit(0).alias("overlap"), F.lit(len(BOUNDARIES)).alias("strength"), F.col("content").alias("text")
    )
    return some.where(size > limit).mapInArrow(run, schema).unionByName(short)


def chapter_items(chapters: DataFrame, segmented: DataFrame) -> DataFrame:
    """Contents of both tables, a repeated row as often as it occurs; null arrays give none."""
    nested = segmented.select("source_id", F.explode("chapters").alias("c"))
    return chapters.select(F.lit("chapters").alias("origin"), F.col("chapter_id").alias("item_id"), "chapter_index", "content").unionByName(
        nested.select(F.lit("segmented_sources").alias("origin"), F.col("source_id").alias("item_id"), F.col("c.chapter_index").alias("chapter_index"), F.col("c.content").alias("content"))
    )
