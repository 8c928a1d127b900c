"""Evaluation texts leaking into training text.

A document holds a passage if it has ``words`` consecutive words of the item. Both sides
are seen as sets of five-word shingles. To find short passages in long documents by
MinHash, containment has to become similarity, for which the search is partitioned by
size. A passage has one size only, so the partitions are of that size on both sides: each
document and item is cut into its windows of a passage's shingles, of which one that is
contained in the other side is equal to a window there, and has the same minimum. One
minimum is thus a signature that never misses, and as windows next to each other mostly
share it, a text has few distinct ones.

Windows of a document whose signature an item has are candidates, and only these are
verified: by the exact containment of all their shingles in the item, one after the other.

The items' windows are sent to every task where their number is at most ``MAX_WINDOWS``,
checked beforehand; beyond that, the documents' signatures meet the items' in a join, and
the windows of the documents that met are verified in a second one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tables import filled
from textloom.llm.words import RUN, distinct_sets, hash_words, owners, positions, runs, window_minima
from textloom.session import Workspace

WORDS = 14
#: With ten shingles each, 20 MB.
MAX_WINDOWS = 200_000


class Windows:
    """The windows of a batch of texts: their signatures, whose they are, and their shingles on demand."""

    def __init__(self, texts: pa.Array, words: int):
        hashes, starts = hash_words(texts)
        self.width = words - RUN + 1
        self.shingles, self.at = runs(hashes, starts, RUN)
        self.signatures, self.begin = window_minima(self.shingles, self.at, self.width)
        self.owner = owners(self.begin)

    def sets(self, windows: np.ndarray) -> np.ndarray:
        """The shingles of the windows of these numbers, a row each."""
        first = self.at[:-1][self.owner[windows]] + windows - self.begin[:-1][self.owner[windows]]
        return self.shingles[first[:, None] + np.arange(self.width)]


def _windows(df: DataFrame, key: str, words: int) -> DataFrame:
    """Rows (key, signature, shingles) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(batch.column("text"), words)
            n = len(w.signatures)
            sets = w.sets(np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(w.owner)),
                    pa.array(w.signatures.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w.width, pa.int32()), pa.array(sets.ravel().view(np.int64))),
                ],
                names=[key, "signature", "shingles"],
            )

    return df.where(filled("text") & F.col(key).isNotNull()).select(key, "text").mapInArrow(run, f"{key} long, signature long, shingles array<long>")


def _signatures(df: DataFrame, key: str, words: int) -> DataFrame:
    """Rows (key, signature), the distinct ones of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Windows(batch.column("text"), words)
            least, where = distinct_sets(w.signatures, w.begin)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owners(where))), pa.array(least.view(np.int64))], names=[key, "signature"])

    return df.where(filled("text") & F.col(key).isNotNull()).select(key, "text").mapInArrow(run, f"{key} long, signature long")


def find_leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Pairs doc_id, item_id, each once: the document holds ``words`` consecutive words of the item.

    Null, empty and blank texts and those of fewer words hold nothing. Documents with the
    same text count one by one; a repeated row once. Extra columns are not looked at.
    """
    if words < RUN:
        raise ValueError(f"a passage has at least {RUN} words")
    ws = Workspace(documents.sparkSession, "leaks")
    known = ws.put(_windows(items, "item_id", words).distinct(), "items")
    if known.count() <= max_windows:
        return _in_tasks(documents, known, words).distinct()
    return _by_join(documents, known, words, ws)


def _in_tasks(documents: DataFrame, known: DataFrame, words: int) -> DataFrame:
    rows = known.toArrow().combine_chunks()
    width = words - RUN + 1
    signatures = rows.column("signature").to_numpy().view(np.uint64)
    order = np.argsort(signatures, kind="stable")
    sets = np.asarray(rows.column("shingles").combine_chunks().flatten()).view(np.uint64).reshape(-1, width)[order] if len(order) else np.zeros((0, width), np.uint64)
    sent = documents.sparkSession.sparkContext.broadcast((signatures[order], sets, rows.column("item_id").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, sets, items = sent.value
        for batch in batches:
            w = Windows(batch.column("text"), words)
            candidates = np.flatnonzero(_among(w.signatures, signatures))
            low, high = (np.searchsorted(signatures, w.signatures[candidates], side) for side in ("left", "right"))
            window, item = np.repeat(candidates, high - low), positions(low, high - low)
            contained = (w.sets(window) == sets[item]).all(axis=1) if len(window) else np.zeros(0, bool)
            pairs = np.unique(np.stack([batch.column("doc_id").to_numpy(zero_copy_only=False)[w.owner[window[contained]]], items[item[contained]]], axis=1).reshape(-1, 2), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["doc_id", "item_id"])

    return documents.where(filled("text") & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long")


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _by_join(documents: DataFrame, known: DataFrame, words: int, ws: Workspace) -> DataFrame:
    """The same with a join on signatures, then one on the windows of the documents that met."""
    wanted = known.select("signature").distinct()
    met = ws.put(_signatures(documents, "doc_id", words).join(wanted, "signature", "left_semi").distinct(), "met")
    some = documents.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    windows = _windows(some, "doc_id", words).join(met, ["doc_id", "signature"], "left_semi")
    return windows.join(known, ["signature", "shingles"]).select("doc_id", "item_id").distinct()
