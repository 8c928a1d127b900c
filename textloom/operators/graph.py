"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import Workspace


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns vertex and component, the lowest vertex of each.

    Alternates two steps until nothing changes: each vertex links its larger neighbours to
    the smallest vertex around it, then its smaller ones. Loops, nulls and repeated edges
    do no harm; an empty input gives an empty result.
    """
    ws = Workspace(edges.sparkSession, "graph")
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna().where("u <> v")
    e = ws.put(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    n, last = 0, summary(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        n += 1
        e = ws.put(small, f"edges-{n}")
        ws.drop(f"edges-{n - 1}")
        now = summary(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
