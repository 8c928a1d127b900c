"""Numbers over a whole table in some order, without gathering it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import Workspace


def number_rows(df: DataFrame, *order: Column, name: str = "number", by: str | None = None) -> DataFrame:
    """Adds consecutive numbers from 1 in the given order, which should be total; ``by`` numbers each of its values' rows.

    Rows are sorted by ranges; each range numbers its own and adds the rows of the ranges
    before it, of which only the counts meet in one task. So a value that a third of all
    rows have is numbered in many tasks.
    """
    ws = Workspace(df.sparkSession, "numbering")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if by else []
    sort = [*(F.asc(k) for k in keys), *order]
    ranged = ws.put(df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")
    before = sizes.select("_range", *keys, (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    joined = ranged.withColumn("_own", own)
    if by:
        joined = joined.join(before.withColumnsRenamed({"_range": "_r", by: "_by"}), (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by"))).drop("_r", "_by")
    else:
        joined = joined.join(F.broadcast(before), "_range")
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")
