"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import chat, cutting, matching, reports, retrieval, texts, versions

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (texts, matching, versions, chat, retrieval, cutting, reports)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
