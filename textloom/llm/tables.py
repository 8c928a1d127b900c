"""Reading the tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ship, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are worked on in Python: on all cores, even where it is one file."""
    return spread(table(spark, folder, name))


def filled(text: str | Column) -> Column:
    """True for a text that is neither null nor empty nor blank (any Unicode white space)."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"[^\s\p{Z}\x{85}]")
