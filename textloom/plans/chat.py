"""Queries over conversations. Documents stand for the turns: a source is a conversation, letters are the user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import similarity as M
from textloom.plans.common import S, sql_list, sql_runs, sql_strip, table
from textloom.plans.texts import SQL as TEXT_SQL
from textloom.session import Workspace, spread

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("doc_kind") == "letter", "user").otherwise("assistant")
    return table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("conv"), "doc_id", "written_at", role.alias("role"), F.coalesce("text", F.lit("")).alias("message"))


def last_turns(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The last n turns of each conversation, place 1 the latest; earlier ones never meet in a task."""
    w = Window.partitionBy("conv").orderBy(F.desc("written_at"), F.desc("doc_id"))
    return turns(spark, d).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


_TURNS = "t AS (SELECT coalesce(source, '') AS conv, doc_id, written_at, CASE WHEN doc_kind = 'letter' THEN 'user' ELSE 'assistant' END AS role, coalesce(text, '') AS message FROM documents), l AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY written_at DESC, doc_id DESC) AS place FROM t)"


@query(f"WITH {_TURNS} SELECT conv, doc_id, role, place, substring(message, 1, 300) AS message FROM l WHERE place <= 10")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return last_turns(spark, d, 10).select("conv", "doc_id", "role", "place", F.substring("message", 1, 300).alias("message"))


@query(f"WITH {_TURNS} SELECT conv, doc_id, CASE WHEN place <= 20 THEN 'active' ELSE 'archived' END AS state FROM l")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty turns of each conversation stay active, older ones are archived."""
    active = last_turns(spark, d, 20).select("conv", "doc_id", "written_at")
    oldest = active.groupBy("conv").agg(F.min(F.struct("written_at", "doc_id")).alias("oldest"))
    all_turns = turns(spark, d).select("conv", "doc_id", "written_at").join(oldest, "conv")
    return all_turns.select("conv", "doc_id", F.when(F.struct("written_at", "doc_id") >= F.col("oldest"), "active").otherwise("archived").alias("state"))


_OPEN = f"""{_TURNS}, q AS (SELECT a.conv, a.doc_id, b.doc_id AS answer_id, b.place AS at, a.message, b.message AS answer,
        row_number() OVER (PARTITION BY a.doc_id ORDER BY b.place DESC) AS k
    FROM l a JOIN l b ON b.conv = a.conv AND b.place BETWEEN a.place - 2 AND a.place - 1 WHERE a.place <= 20 AND a.role = 'user' AND contains(a.message, '?') AND b.role = 'assistant')"""


@query(f"WITH {_OPEN} SELECT conv, doc_id, answer_id, regexp_matches(lower(answer), '{'|'.join(T.UNSURE)}') AS unsure FROM q WHERE k = 1")
def open_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions among the last turns with the first answer in the two turns after, and whether it is none."""
    w = Window.partitionBy("conv").orderBy("written_at", "doc_id")
    t = last_turns(spark, d, 20)
    for k in (1, 2):
        t = t.withColumn(f"r{k}", F.lead("role", k).over(w)).withColumn(f"d{k}", F.lead("doc_id", k).over(w)).withColumn(f"m{k}", F.lead("message", k).over(w))
    first, second = F.col("r1") == "assistant", F.col("r2") == "assistant"
    answer = F.when(first, F.struct(F.col("d1").alias("id"), F.col("m1").alias("m"))).when(second, F.struct(F.col("d2").alias("id"), F.col("m2").alias("m")))
    asked = t.where((F.col("role") == "user") & F.col("message").contains("?")).withColumn("answer", answer).where("answer is not null")
    return asked.select("conv", "doc_id", F.col("answer.id").alias("answer_id"), F.lower("answer.m").rlike("|".join(T.UNSURE)).alias("unsure"))


@query(f"""WITH q AS ({TEXT_SQL['search_query']}), n AS (SELECT doc_id, query, trim(lower(substring(query, 1, 50)), ' ' || chr(10) || chr(9) || chr(13)) AS needle FROM q WHERE query <> ''),
    k AS (SELECT DISTINCT lower(text) AS note FROM documents WHERE doc_kind = 'blog' AND text IS NOT NULL)
    SELECT n.doc_id FROM n WHERE n.needle <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE contains(k.note, n.needle))""")
def not_researched(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose query's first 50 characters occur in none of the notes (blog entries), whatever the case.

    The words inside a needle, without its first and last that may be parts of words, stand in a row in
    each note that holds it. A needle meets the notes by the rarest of these runs and is then searched in
    them; only needles of hardly any words, each once, are searched in all notes.
    """
    ws = Workspace(spark, "notes")
    docs = table(spark, d, "documents")
    needle = F.trim(F.lower(F.substring(T.search_query(F.col("text")), 1, 50)), F.lit(" \n\t\r"))
    q = ws.put(spread(docs).select("doc_id", needle.alias("needle")).where("needle <> ''"), "queries")
    notes = ws.put(spread(docs).where("doc_kind = 'blog'").select(F.lower("text").alias("note")).where("note is not null").distinct().withColumn("note_id", F.monotonically_increasing_id()), "notes")
    needles = q.select("needle").distinct()

    words = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    inner = needles.withColumn("w", words(F.col("needle"))).withColumn("w", F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)))
    inner = inner.withColumn("k", F.when(F.size("w") >= LONG_RUN, LONG_RUN).when(F.size("w") >= SHORT_RUN, SHORT_RUN))
    runs = ws.put(inner.where("k is not null").select("needle", F.explode(F.array_distinct(_runs(F.col("w"), F.col("k")))).alias("run")), "runs")
    wanted = runs.select("run").distinct()
    split = notes.select("note_id", words(F.col("note")).alias("w"))
    held = F.explode(F.array_distinct(F.concat(*(_runs(F.col("w"), F.lit(k)) for k in (SHORT_RUN, LONG_RUN)))))
    found = ws.put(split.select("note_id", held.alias("run")).join(wanted, "run", "left_semi"), "found")
    often = found.groupBy("run").agg(F.count("*").alias("often"))
    # a run that no note has is the rarest there is
    rarest = runs.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "run")).alias("r")).select("needle", "r.run")
    met = rarest.join(found, "run").select("needle", "note_id").join(notes, "note_id").where(F.col("note").contains(F.col("needle"))).select("needle")
    few = inner.where("k is null").select("needle")
    met_few = few.join(notes, F.col("note").contains(F.col("needle")), "left_semi")
    return q.join(met.union(met_few).distinct(), "needle", "left_anti").select("doc_id")


#: Words of the runs by which needles meet notes: long ones, and short ones for needles of few words.
LONG_RUN, SHORT_RUN = 4, 2


def _runs(words: Column, k: Column) -> Column:
    """Hashes of all runs of k words; none where there are fewer."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


_MOOD = TEXT_SQL["mood"]


@query(f"""WITH {_TURNS}, m AS ({_MOOD}), r AS (SELECT l.conv, m.mood FROM l JOIN m USING (doc_id) WHERE place <= 10 AND role = 'assistant')
    SELECT conv, count(*) AS n, count(*) FILTER (WHERE mood = 'sachlich') AS n_factual, count(*) FILTER (WHERE mood = 'sachlich') > count(*) / 2 AS alarm FROM r GROUP BY conv""")
def tone_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Is the factual mood that of more than half of the answers among the last ten turns."""
    r = last_turns(spark, d, 10).where("role = 'assistant'").select("conv", T.mood(F.col("message")).alias("mood"))
    n = F.count(F.when(F.col("mood") == "sachlich", 1))
    return r.groupBy("conv").agg(F.count("*").alias("n"), n.alias("n_factual"), (n > F.count("*") / 2).alias("alarm"))


_PLAIN = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{S}+'), lambda w: w <> '')"


@query(f"""
    WITH w AS (SELECT id, {_PLAIN} AS w FROM (SELECT DISTINCT file_id AS id, body AS text FROM incoming_files) WHERE text IS NOT NULL), s AS (SELECT id, {sql_runs('w', 3)} AS s FROM w),
    u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s), p AS (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS sim FROM u a JOIN u b USING (x) WHERE a.id < b.id GROUP BY a.id, b.id, a.n, b.n)
    SELECT b AS file_id, count(*) AS n_links, min(a) AS first_id FROM p WHERE sim >= 4e-1 GROUP BY b""")
def near_dup_messages(spark: SparkSession, d: str) -> DataFrame:
    """Files that say nearly what an earlier one says (0.4 of their three-word runs): the number and the first of these.

    Bodies of equal runs are one class, compared once; each file then counts the files
    before it in its own class and in the similar ones.
    """
    ws = Workspace(spark, "messages")
    files = spread(table(spark, d, "incoming_files")).where("body is not null and file_id is not null").select("file_id", M.hashed(T.plain_shingles(F.col("body"))).alias("members")).where(F.size("members") > 0)
    files = ws.put(files.withColumn("class", M.set_key("members")).dropDuplicates(["file_id", "class"]), "files")
    rows = files.select("file_id", "class")
    sets = ws.put(files.groupBy("class").agg(F.min("file_id").alias("file_id")).join(files, ["class", "file_id"]).select(F.col("class").alias("id"), "members"), "sets")
    similar = ws.put(M.self_similar(sets, 0.4).select("a", "b"), "similar")
    # the files of a class and of one like it in the order of their numbers: those of the latter before each of the former
    both = similar.union(similar.select("b", "a")).union(sets.select("id", "id"))
    asked = both.join(rows.withColumnRenamed("class", "a"), "a").select("a", "b", "file_id", F.lit(None).cast(files.schema["file_id"].dataType).alias("earlier"))
    there = both.join(rows.withColumnRenamed("class", "b"), "b").select("a", "b", "file_id", F.col("file_id").alias("earlier"))
    before = Window.partitionBy("a", "b").orderBy("file_id").rangeBetween(Window.unboundedPreceding, -1)
    counted = asked.union(there).withColumn("n", F.count("earlier").over(before)).withColumn("first", F.min("earlier").over(before))
    return counted.where("earlier is null and n > 0").groupBy("file_id").agg(F.sum("n").alias("n_links"), F.min("first").alias("first_id"))


@query("""WITH u AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) - 1 AS seq FROM documents)
    SELECT doc_id, seq, length(part) AS chars FROM u""")
def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """A log's entries by number."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("seq", "part")).select("doc_id", "seq", F.length("part").alias("chars"))
