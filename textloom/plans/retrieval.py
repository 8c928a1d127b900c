"""Search: by vectors, by words, and what is made of the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.vectors import top_k
from textloom.plans.common import table
from textloom.session import spread

QUERIES = {}
SQL: dict[str, str] = {}
TERMS = {"q1": ["der", "stille", "garten"], "q2": ["lantern", "quarrel"], "q3": ["voisin", "pâle", "voisin"], "q4": ["niebla"], "q5": ["kein", "treffer", "xyzzy"]}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    p AS (SELECT q.vec_id AS query_id, v.vec_id, round(1e0 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) + 0e0 AS distance FROM v q, v WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM p) WHERE r <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 20, against all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return top_k(v.where("vec_id % 20 = 0"), v, 5)


def search_library(spark: SparkSession, vectors: DataFrame, asked: DataFrame, texts: DataFrame, terms: dict[str, list[str]], n: int = 5) -> DataFrame:
    """Rows query, id, distance: the nearest vectors (vec_id, embedding) of the queries (vec_id as name, embedding); where there are none at all, the best texts (doc_id, text) by words."""
    if not vectors.isEmpty():
        return top_k(asked, vectors, n).select(F.col("query_id").cast("string").alias("query"), F.col("vec_id").alias("id"), "distance")
    hits = word_hits(texts, terms)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("query", F.col("doc_id").alias("id"), (F.lit(1.0) / (1 + F.col("score"))).alias("distance"))


def word_hits(texts: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Rows doc_id, text, query, score of the texts that hold a term of a query."""
    return texts.select(
        "doc_id", "text", F.explode(F.array(*(F.struct(F.lit(q).alias("query"), T.occurrences(F.col("text"), words).alias("score")) for q, words in terms.items()))).alias("x")
    ).select("doc_id", "text", "x.query", "x.score").where("score > 0")


def _search(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Rows (query, doc_id, score, distance) of the n best texts of each query in TERMS."""
    hits = word_hits(spread(table(spark, d, "documents")), TERMS)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def _occurs(terms: list[str]) -> str:
    return " + ".join(f"(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{t}', ''))) // {len(t)}" for t in terms)


_HITS = "h AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id, text, {_occurs(terms)} AS score FROM documents" for q, terms in TERMS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM h WHERE score > 0)"


def _snip(terms: list[str]) -> str:
    at = "least(" + ", ".join(f"CASE WHEN strpos(lower(text), '{t}') > 0 THEN strpos(lower(text), '{t}') - 1 ELSE length(text) END" for t in terms) + ", length(text))"
    return f"CASE WHEN greatest({at} - 150, 0) > 0 THEN '...' ELSE '' END || substring(text, greatest({at} - 150, 0) + 1, least(length(text), {at} + 150) - greatest({at} - 150, 0)) || CASE WHEN least(length(text), {at} + 150) < length(text) THEN '...' ELSE '' END"


@query(f"WITH {_HITS} SELECT query, doc_id, score::INT AS score, 1e0 / (1 + score) AS distance FROM r WHERE r <= 5")
def fulltext_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 5).select("query", "doc_id", "score", (F.lit(1.0) / (1 + F.col("score"))).alias("distance"))


_SNIPPET = "CASE query " + " ".join(f"WHEN '{q}' THEN {_snip(list(dict.fromkeys(t)))}" for q, t in TERMS.items()) + " END"


@query(f"WITH {_HITS} SELECT query, doc_id, {_SNIPPET} AS snippet FROM r WHERE r <= 5")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    s = F.lit(None).cast("string")
    for q, terms in TERMS.items():
        s = F.when(F.col("query") == q, T.snippet(F.col("text"), list(dict.fromkeys(terms)))).otherwise(s)
    return _search(spark, d, 5).select("query", "doc_id", s.alias("snippet"))


@query(f"WITH {_HITS} SELECT query, string_agg(substring(text, 1, 500), chr(10) || '---' || chr(10) ORDER BY r) AS context FROM r WHERE r <= 3 GROUP BY query")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of each query's three best texts, joined."""
    parts = _search(spark, d, 3).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", F.substring("text", 1, 500).alias("t")))).alias("x"))
    return parts.select("query", F.array_join(F.transform("x", lambda x: x.t), "\n---\n").alias("context"))


@query(f"WITH {_HITS}, k AS (SELECT query, doc_id, r, row_number() OVER (ORDER BY query, r) AS place FROM r WHERE r <= 3) SELECT query, doc_id, r AS rank, place FROM k WHERE place <= 15")
def multi_query(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen of all queries' three best hits, in order of the queries."""
    top = _search(spark, d, 3).select("query", "doc_id", F.col("r").alias("rank"))
    return top.withColumn("place", F.row_number().over(Window.orderBy("query", "rank"))).where("place <= 15")
