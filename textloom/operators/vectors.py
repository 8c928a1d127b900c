"""Nearest vectors, exactly, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 512, 4096


def _blocks(vectors: DataFrame, size: int, prefix: str) -> DataFrame:
    """Vectors in blocks of about ``size`` rows, by a hash: block, ids, and the coordinates in one array."""
    some = vectors.where("vec_id is not null and embedding is not null")
    n = max(1, -(-some.count() // size))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    return some.groupBy(block.alias(f"{prefix}block")).agg(F.collect_list("vec_id").alias(f"{prefix}ids"), F.flatten(F.collect_list("embedding")).alias(f"{prefix}xs"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Rows query_id, vec_id, distance: the k vectors of least cosine distance of each query.

    Both inputs have vec_id and embedding, all of one length. Distances are rounded, ties go
    to the lowest vec_id; vectors of length nought are at distance 1 from all, null ones
    and null ids have no row. Each pair of a block of queries and a block of rows is one
    product of matrices, of which only k rows a query leave the task.
    """
    pairs = _blocks(queries, QUERY_BLOCK, "q").crossJoin(_blocks(vectors, ROW_BLOCK, "v"))  # blocks, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                q, v = (np.asarray(batch.column(f"{s}ids")[row].values, np.int64) for s in "qv")
                a, b = (np.asarray(batch.column(f"{s}xs")[row].values, np.float64).reshape(len(ids), -1) for s, ids in (("q", q), ("v", v)))
                norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    distance = np.round(1 - np.where(norms > 0, (a @ b.T) / norms, 0.0), digits)
                best = np.lexsort((np.broadcast_to(v, distance.shape), distance), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q, best.shape[1])), pa.array(v[best].ravel()), pa.array(np.take_along_axis(distance, best, axis=1).ravel() + 0.0)], names=["query_id", "vec_id", "distance"]
                )

    near = pairs.select("qids", "qxs", "vids", "vxs").mapInArrow(run, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def mapped(df: DataFrame, function, schema: str) -> DataFrame:  # noqa: ANN001
    """The table through a function of whole batches (an iterator of pandas frames), such as one that asks a model from outside."""
    return df.mapInPandas(function, schema)
