"""Queries that cut texts: chapters, chunks, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.common import S, sql_strip, table
from textloom.session import spread
from textloom.sources import chapters, segment
from textloom.sources.files import SKIPPED, html_to_markdown

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_H1 = rf"(?m)^#{S}+(.+)$"


@query(f"""
    WITH t AS (SELECT DISTINCT source_id, filename, text, len(regexp_extract_all(text, '{_H1}')) AS n FROM source_documents WHERE text IS NOT NULL),
    p AS (SELECT source_id, filename, n, CASE WHEN n >= 5 THEN list_slice(string_split(regexp_replace(text, '{_H1}', chr(1) || '\\1' || chr(2), 'g'), chr(1)), 2, NULL) ELSE [text] END AS parts FROM t),
    u AS (SELECT source_id, filename, n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS chapter_index FROM p)
    SELECT source_id, chapter_index, CASE WHEN n >= 5 THEN {sql_strip("split_part(part, chr(2), 1)")} ELSE '(gesamt: ' || filename || ')' END AS title, CASE WHEN n >= 5 THEN md5({sql_strip("split_part(part, chr(2), 2)")}) ELSE md5(part) END AS content_md5 FROM u""")
def segment_h1(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of the source documents at their first-level headings, where there are five; else the whole text."""
    t = table(spark, d, "source_documents").where("text is not null").select("source_id", "filename", "text").distinct()
    cut = F.regexp_replace("text", _H1, "\x01$1\x02")
    t = t.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(_H1), 0)))
    parts = F.when(F.col("n") >= 5, F.split(cut, "\x01")).otherwise(F.array(F.lit(""), F.col("text")))
    u = t.select("source_id", "filename", "n", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("chapter_index", "part"))
    many = F.col("n") >= 5
    title = F.when(many, T.strip(F.substring_index("part", "\x02", 1))).otherwise(F.format_string("(gesamt: %s)", "filename"))
    content = F.when(many, T.strip(F.get(F.split("part", "\x02"), F.lit(1)))).otherwise(F.col("part"))
    return u.select("source_id", "chapter_index", title.alias("title"), F.md5(content).alias("content_md5"))


_PAGE = r"regexp_replace(regexp_replace(regexp_replace(body, '(?i)</(p|div|h[1-6]|li|br)>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_TAGS = "(?i)" + "|".join(f"<{t}[^>]*>([^<]+)</{t}>" for t in ("h1", "h2", "h3", "title"))


def _basic(col: str) -> str:
    for entity, sign in T.BASIC_ENTITIES:
        col = f"replace({col}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return col


@query(f"""
    WITH t AS (SELECT DISTINCT kb_id, coalesce(kb_kind, '') AS book, filename, body FROM kb_entries WHERE body IS NOT NULL AND regexp_matches(body, '<[a-zA-Z]') AND NOT regexp_matches(lower(filename), '{SKIPPED.pattern}')),
    p AS (SELECT book, filename, {sql_strip(_basic(_PAGE))} AS content, {sql_strip(_basic("coalesce(" + ", ".join(f"nullif(regexp_extract(body, '{_TAGS}', {k}), '')" for k in range(1, 5)) + ", substring(nullif(regexp_extract(body, '(?i)<p[^>]*>([^<]+)</p>', 1), ''), 1, 80))"))} AS title FROM t),
    n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY filename) - 1 AS k FROM p WHERE length(content) >= 20)
    SELECT book AS source_file, k AS chapter_index, substring(coalesce(title, '(Datei ' || k || ')'), 1, 100) AS title, md5(content) AS content_md5 FROM n""")
def page_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Entries with HTML as the pages of a book by kind: chapters in the order of their names, without gaps."""
    pages = table(spark, d, "kb_entries").where(F.col("body").rlike("<[a-zA-Z]")).select("kb_id", F.coalesce("kb_kind", F.lit("")).alias("book"), F.col("filename").alias("name"), F.col("body").alias("page")).distinct()

    def decode(c):  # noqa: ANN001, ANN202
        for entity, sign in T.BASIC_ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(sign))
        return c

    return chapters.page_chapters(pages, decode).select("source_file", "chapter_index", "title", F.md5("content").alias("content_md5"))


@query()
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of the source documents with the strategy that found them."""
    return segment.segments(spread(table(spark, d, "source_documents")))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of the entries, for a vector store."""
    return segment.chunks(spread(table(spark, d, "kb_entries")).withColumn("name", F.regexp_replace("filename", r"\.[^.]*$", "")), "name", "body")


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Entries with HTML as Markdown."""
    pages = spread(table(spark, d, "kb_entries")).where(F.col("body").rlike("<[a-zA-Z]"))
    return pages.select("kb_id", html_to_markdown("body").alias("markdown")).distinct()
