"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every level draws a start time for each vertex from an exponential distribution, shifted
so that the luckiest start first, and lets clusters grow from there one hop a round; a
vertex joins the cluster that reaches it first. The clusters become the vertices of the
next level, which has only the edges between clusters. When no edge is left, composing
the levels' assignments gives each vertex its component.

Start times come from a hash of the vertex and the level, so a task that runs again after
an executor was lost draws the same ones. They lie in [0, ROUNDS], so ROUNDS hops reach a
fixpoint: a cluster that started later than ROUNDS - d can't win a vertex d hops away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import Workspace

ROUNDS = 5
RATE = 0.3


def chapter_edges(matches: DataFrame, chapters: DataFrame) -> DataFrame:
    """Edges (a, b) between chapter ids, each once with a < b.

    A match names its chapters by source and index. Rows with a null name, naming a
    chapter that isn't there, or the same one twice, give no edge; repeated rows and
    rows in the other direction give one.
    """
    m = matches.select("source_a", "index_a", "source_b", "index_b").dropna().distinct()
    named = (
        m.select(F.col("source_a").alias("s"), F.col("index_a").alias("i"))
        .union(m.select("source_b", "index_b"))
        .distinct()
    )
    c = chapters.select(F.col("source_file").alias("s"), F.col("chapter_index").alias("i"), "chapter_id").dropna()
    known = c.join(named, ["s", "i"]).distinct()
    return (
        m.join(known.select(F.col("s").alias("source_a"), F.col("i").alias("index_a"), F.col("chapter_id").alias("x")), ["source_a", "index_a"])
        .join(known.select(F.col("s").alias("source_b"), F.col("i").alias("index_b"), F.col("chapter_id").alias("y")), ["source_b", "index_b"])
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def _start(vertex: Column, level: int) -> Column:
    """ROUNDS minus an exponential draw of the given rate, cut off at ROUNDS."""
    unit = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return F.lit(float(ROUNDS)) - F.least(-F.log(unit) / RATE, F.lit(float(ROUNDS)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns vertex, root and group_id (the lowest vertex of the component).

    Edges may be repeated, in either direction, loops or null; loops and nulls give no
    vertex. An empty input gives an empty result. Hub vertices: their edges stream
    through the join by source, which AQE splits, and are reduced before the next shuffle.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "components")
    e = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).dropna().where("src <> dst")
    e = ws.put(e.union(e.select("dst", "src")).distinct(), "edges-0")
    levels: list[DataFrame] = []
    while not e.isEmpty():
        n = len(levels)
        # a loop keeps a vertex's own claim, so that each round is one join and one aggregation
        hops = e.union(e.select("src", F.col("src").alias("dst")).distinct())
        state = e.select(F.col("src").alias("v")).distinct().select("v", F.struct(_start(F.col("v"), n).alias("at"), F.col("v").alias("c")).alias("claim"))
        for _ in range(ROUNDS):
            state = (
                hops.join(state, hops.src == state.v)
                .select(F.col("dst").alias("v"), F.struct((F.col("claim.at") + F.when(F.col("src") == F.col("dst"), 0.0).otherwise(1.0)).alias("at"), F.col("claim.c").alias("c")).alias("claim"))
                .groupBy("v")
                .agg(F.min("claim").alias("claim"))
            )
        assigned = ws.put(state.select("v", F.col("claim.c").alias("c")), f"assigned-{n}")
        levels.append(assigned)
        between = (
            e.join(assigned.withColumnsRenamed({"v": "src", "c": "cs"}), "src")
            .join(assigned.withColumnsRenamed({"v": "dst", "c": "cd"}), "dst")
            .where("cs <> cd")
            .select(F.col("cs").alias("src"), F.col("cd").alias("dst"))
            .distinct()
        )
        e = ws.put(between, f"edges-{n + 1}")
        ws.drop(f"edges-{n}")
    ws.drop(f"edges-{len(levels)}")
    if not levels:
        return spark.createDataFrame([], "vertex long, root long, group_id long")
    whole = levels[-1].withColumnRenamed("c", "root")
    for assigned in reversed(levels[:-1]):
        whole = assigned.join(whole.withColumnRenamed("v", "c"), "c", "left").select("v", F.coalesce("root", "c").alias("root"))
    whole = ws.put(whole, "roots")
    for n in range(len(levels)):
        ws.drop(f"assigned-{n}")
    lowest = whole.groupBy("root").agg(F.min("v").alias("group_id"))
    return whole.join(lowest, "root").select(F.col("v").alias("vertex"), "root", "group_id")


def chapter_groups(matches: DataFrame, chapters: DataFrame) -> DataFrame:
    """Columns chapter_id and group_id: every chapter that is linked to another one."""
    return connected_components(chapter_edges(matches, chapters)).select(F.col("vertex").alias("chapter_id"), "group_id")
