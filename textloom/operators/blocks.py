"""Similarity joins on many sets, with what must move packed into blocks of sets.

A block holds the sets of one Arrow batch. Its elements go to buckets as sorted differences
with the number of their set in the block, a few bytes each; a bucket counts its elements and
sends back those that more than one set has, by short codes. So each block learns the shared
elements of its sets in one exchange there and a small one back, and no set moves as rows.

Short sets meet by several elements at once: pairs of titles that share only common words
would otherwise grow with the square of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a bucket, about.
BUCKET = 500_000
#: So many elements at once bring a pair of short sets together, of a pair that needs to share TOGETHER or more, up to MOST.
TOGETHER, MOST = 4, 10

_PACKED = "block long, bucket int, elements binary, owners binary, often binary"


def pack(x: np.ndarray) -> bytes:
    """Integers as planes of their bytes, so that the high ones, which are alike, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unpack(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    x = x.view(np.uint64)
    return pack(np.diff(x, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "bucket", "elements", "owners", "often"])


def _by_block(buckets: int):  # noqa: ANN202
    bounds = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(flat, kind="stable")
            flat, owners = flat[order], np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)[order]
            # the sets' ids and sizes, for the way back
            rows = [(block, -1 - block % buckets, pack(batch.column(0).to_numpy(zero_copy_only=False)), pack(sizes), b"")]
            cuts = [0, *np.searchsorted(flat, bounds).tolist(), len(flat)]
            rows += [(block, k, pack_sorted(flat[i:j]), pack(owners[i:j]), b"") for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
            yield _batch(rows)
            block += 1

    return run


def _by_bucket(buckets: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "elements", "owners", "often")), strict=True))
        if rows[0][1] < 0:
            return table
        parts = [unpack_sorted(r[2]) for r in rows]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        new = np.diff(flat[order], prepend=flat[order[:1]] ^ np.uint64(1)) != 0
        group = np.cumsum(new) - 1
        counts = np.bincount(group)
        often, code = np.empty(len(flat), np.uint32), np.empty(len(flat), np.uint64)
        often[order] = counts[group]
        # codes of the shared elements alone, in the elements' order, so that each block's stay sorted
        number = np.cumsum(counts > 1) - 1
        code[order] = (number[group] * buckets + rows[0][1]).astype(np.uint64)
        out, at = [], 0
        for (block, bucket, _, owners, _), part in zip(rows, parts, strict=True):
            own = slice(at, at + len(part))
            at += len(part)
            kept = often[own] > 1
            if kept.any():
                out.append((block, bucket, pack_sorted(code[own][kept]), pack(unpack(owners, np.uint32)[kept]), pack(often[own][kept])))
        return pa.Table.from_batches([_batch(out)])

    return run


def _by_set(threshold: float):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "elements", "owners", "often")), strict=True))
        (head,) = (r for r in rows if r[0] < 0)
        ids, n = unpack(head[1], np.int64), unpack(head[2], np.uint32).astype(np.int64)
        some = [r for r in rows if r[0] >= 0]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        code, owners, often = (join([f(r[k]) for r in some], kind) for k, kind, f in ((1, np.uint64, unpack_sorted), (2, np.uint32, lambda b: unpack(b, np.uint32)), (3, np.uint32, lambda b: unpack(b, np.uint32))))
        k = np.bincount(owners, minlength=len(ids))
        # a set that shares less than this with all others together has no partner
        able = (k > 0) & (k >= np.ceil(n * threshold - 1e-9))
        order = np.lexsort((code, often, owners))
        order = order[able[owners[order]]]
        offsets = np.concatenate([[0], np.cumsum(k[able])])
        few = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code[order].astype(np.int64)))
        return pa.Table.from_arrays([pa.array(ids[able]), pa.array(n[able].astype(np.int32)), few], ["id", "n", "few"])

    return run


def shared_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows id, n, few for the sets (id, members of 64-bit hashes) that may have a partner at the threshold.

    n is the size of the set; few has codes of its elements that other sets have too, the rarest first.
    """
    total = sets.agg(F.sum(F.size("members"))).first()[0] or 0
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    packed = sets.select(F.col("id").cast("long").alias("id"), "members").mapInArrow(_by_block(buckets), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_by_bucket(buckets), _PACKED)
    return counted.groupBy("block").applyInArrow(_by_set(threshold), "id long, n int, few array<long>")


def prefixes(shared: DataFrame, threshold: float) -> DataFrame:
    """Rows id, n, element, rank of shared_sets: what a join at the threshold needs of each set."""
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int")
    first = shared.select("id", "n", F.size("few").alias("k"), F.posexplode(F.slice("few", 1, F.size("few") - least + 1)).alias("at", "element"))
    return first.select("id", "n", "element", (F.col("n") - F.col("k") + F.col("at") + 1).alias("rank"))


def _together(threshold: float):  # noqa: ANN202
    subsets: dict[tuple[int, int], np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, few = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            flat, k = few.flatten().to_numpy(zero_copy_only=False), few.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(k) - k
            for n, m in {*zip(sizes.tolist(), k.tolist(), strict=True)}:
                own = np.flatnonzero((sizes == n) & (k == m))
                sets = flat[starts[own][:, None] + np.arange(m)].view(np.uint64)
                for least in range(int(np.ceil(n * threshold - 1e-9)), min(m, MOST) + 1):
                    met = min(least, TOGETHER)
                    what = (m - least + met, met)
                    if what not in subsets:
                        subsets[what] = np.array(list(combinations(range(what[0]), met)), np.int64)
                    at = subsets[what]
                    key = np.full((len(own), len(at)), least, np.uint64)
                    for j in range(met):
                        key = (key ^ sets[:, at[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    rows = key.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[own], len(at))), pa.array(np.full(rows, n, np.int32)), pa.array(np.full(rows, least, np.int32)), pa.array(key.ravel().view(np.int64))], ["id", "n", "least", "key"]
                    )

    return run


def needed(threshold: float, a: Column, b: Column) -> Column:
    """Elements that sets of these sizes share at the threshold, at least."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9).cast("int")


def met_together(shared: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, some more than once, of the sets (id, n, few) that share TOGETHER of their rarest elements, or all that they need to.

    Of two sets that share so many elements, the rarest of these stand before as many in
    either as are left. For each number up to MOST that a pair may need to share, a set has the
    runs of elements that may be those; pairs that need more aren't among these.
    """
    keys = shared.mapInArrow(_together(threshold), "id long, n int, least int, key long")
    x, y = (keys.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), "least", "key") for s in "xy")
    # y is the smaller one: where both are larger than this, they would have to share more
    y = y.where(needed(threshold, F.col("ny"), F.col("ny")) <= F.col("least"))
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    pairs = x.join(y, ["key", "least"]).where(smaller & (needed(threshold, F.col("nx"), F.col("ny")) == F.col("least")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
