"""Versions of one text: groups by name, categories, winners, lines that only a loser has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.common import sql_strip, sql_title, table
from textloom.session import Workspace

QUERIES = {}
SQL: dict[str, str] = {}
SPLIT = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Entries by base: their title without number, suffix and case."""
    body = T.strip(F.coalesce("body", F.lit("")))
    return table(spark, d, "kb_entries").select("kb_id", T.normal_title(F.coalesce("title", F.lit(""))).alias("base"), body.alias("body")).where("base <> ''").distinct()


_VERSIONS = f"v AS (SELECT DISTINCT kb_id, {sql_title(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} AS base, {sql_strip('coalesce(body, ' + chr(39) * 2 + ')')} AS body FROM kb_entries), w AS (SELECT *, length(body) AS n FROM v WHERE base <> '')"


@query(f"WITH {_VERSIONS} SELECT base, count(*) AS n_versions FROM w GROUP BY base HAVING count(*) > 1")
def version_groups(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).groupBy("base").agg(F.count("*").alias("n_versions")).where("n_versions > 1")


@query(f"WITH {_VERSIONS} SELECT base, arg_max(kb_id, (n, kb_id)) AS winner, max(n) AS body_chars FROM w GROUP BY base HAVING count(*) > 1")
def version_winner(spark: SparkSession, d: str) -> DataFrame:
    """The version with the longest body, of equals the highest id."""
    return _winner(versions(spark, d))


def _winner(v: DataFrame) -> DataFrame:
    best = v.groupBy("base").agg(F.max(F.struct(F.length("body").alias("n"), "kb_id")).alias("b"), F.count("*").alias("c")).where("c > 1")
    return best.select("base", F.col("b.kb_id").alias("winner"), F.col("b.n").alias("body_chars"))


def _lines(body: str = "body"):  # noqa: ANN202
    return F.filter(F.transform(F.split(body, SPLIT), T.strip), lambda x: x != "")


_LINES = f"list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
_UNIQUE = f"""{_VERSIONS}, g AS (SELECT base, arg_max(kb_id, (n, -kb_id)) AS longest, max(n) AS most, min(n) AS least, count(DISTINCT md5(body)) AS n_bodies FROM w GROUP BY base HAVING count(*) > 1),
    l AS (SELECT kb_id, base, unnest({_LINES}) AS line FROM w),
    x AS (SELECT l.base, l.kb_id, l.line FROM l JOIN g USING (base) WHERE l.kb_id <> g.longest AND NOT EXISTS (SELECT 1 FROM l m WHERE m.kb_id = g.longest AND m.line = l.line))"""


def _groups(v: DataFrame) -> DataFrame:
    return v.groupBy("base").agg(
        F.max(F.struct(F.length("body").alias("n"), (-F.col("kb_id")).alias("k"))).alias("b"), F.min(F.length("body")).alias("least"), F.count_distinct(F.md5("body")).alias("n_bodies"), F.count("*").alias("c")
    ).where("c > 1").select("base", (-F.col("b.k")).alias("longest"), F.col("b.n").alias("most"), "least", "n_bodies")


def _only(v: DataFrame) -> DataFrame:
    """Lines of each version but the longest that the longest hasn't, as often as they occur."""
    g = _groups(v)
    lines = v.join(g.select("base", "longest"), "base").select("base", "kb_id", "longest", F.explode(_lines()).alias("line"))
    kept = lines.where("kb_id = longest").select(F.col("base"), "line").distinct()
    return lines.where("kb_id <> longest").join(kept, ["base", "line"], "left_anti").select("base", "kb_id", "line")


@query(f"WITH {_UNIQUE} SELECT base, kb_id, count(*) AS n_unique, min(substring(line, 1, 200)) AS first_line FROM x GROUP BY 1, 2")
def unique_lines(spark: SparkSession, d: str) -> DataFrame:
    return _only(versions(spark, d)).groupBy("base", "kb_id").agg(F.count("*").alias("n_unique"), F.min(F.substring("line", 1, 200)).alias("first_line"))


@query(f"""WITH {_UNIQUE} SELECT base, CASE WHEN n_bodies = 1 THEN 'IDENTICAL' WHEN CASE WHEN most > 0 THEN 100e0 * (most - least) / most ELSE 0 END < 2 THEN 'TRIVIAL' WHEN 100e0 * (most - least) / most < 10 THEN 'MINOR'
    WHEN base IN (SELECT base FROM x) THEN 'MAJOR_UNIQUE' ELSE 'MAJOR_SUBSET' END AS category FROM g""")
def dedup_category(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return _category(v, _only(v))


def _category(v: DataFrame, only: DataFrame) -> DataFrame:
    percent = F.when(F.col("most") > 0, 100.0 * (F.col("most") - F.col("least")) / F.col("most")).otherwise(0.0)
    some = only.select("base").distinct().withColumn("some", F.lit(True))
    category = F.when(F.col("n_bodies") == 1, "IDENTICAL").when(percent < 2, "TRIVIAL").when(percent < 10, "MINOR").when(F.col("some"), "MAJOR_UNIQUE").otherwise("MAJOR_SUBSET")
    return _groups(v).join(some, "base", "left").select("base", category.alias("category"))


@query(f"""WITH {_UNIQUE}, c AS (SELECT base, n_bodies > 1 AND most > 0 AND 100e0 * (most - least) / most >= 10 AND base IN (SELECT base FROM x) AS major FROM g),
    b AS (SELECT base, arg_max(kb_id, (n, kb_id)) AS winner FROM w GROUP BY base)
    SELECT w.kb_id, CASE WHEN w.kb_id = b.winner THEN 'keep' WHEN c.major AND (w.base, w.kb_id) IN (SELECT (base, kb_id) FROM x) THEN 'review' ELSE 'safe' END AS decision FROM w JOIN c USING (base) JOIN b USING (base)""")
def archive_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each version: the winner is kept, losers are archived, for review where a major version has lines of its own."""
    ws = Workspace(spark, "versions")
    v = ws.put(versions(spark, d), "versions")
    only = ws.put(_only(v).select("base", "kb_id").distinct().withColumn("own", F.lit(True)), "own")
    major = _category(v, only).select("base", (F.col("category") == "MAJOR_UNIQUE").alias("major"))
    winner = _winner(v).select("base", "winner")
    rows = v.select("base", "kb_id").join(major, "base").join(winner, "base").join(only, ["base", "kb_id"], "left")
    return rows.select("kb_id", F.when(F.col("kb_id") == F.col("winner"), "keep").when(F.col("major") & F.col("own").isNotNull(), "review").otherwise("safe").alias("decision"))
