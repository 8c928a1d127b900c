"""Queries over the tables of a folder, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    from textloom.plans import registry

    return registry.queries()["status_counts"](spark, folder)
