"""Queries that match texts: incoming files against the knowledge base, chapters against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph
from textloom.operators import similarity as M
from textloom.operators.numbering import number_rows
from textloom.plans.common import sql_display, sql_runs, sql_title, sql_tokens, sql_words, table
from textloom.plans.texts import chapter_score
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


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incoming files and entries with their shingle sets as hashes, a repeated row once."""
    incoming = spread(table(spark, d, "incoming_files")).select(F.col("file_id").alias("id"), "source_bucket", M.hashed(T.shingles(F.col("body"))).alias("members")).dropDuplicates(["id"])
    kb = spread(table(spark, d, "kb_entries")).select("kb_id", M.hashed(T.shingles(F.col("body"))).alias("members")).dropDuplicates(["kb_id"])
    ws = Workspace(spark, "sides")
    return tuple(ws.put(side.withColumn("set", M.set_key("members")), name) for side, name in ((incoming, "files"), (kb, "entries")))


def _overlapping(incoming: DataFrame, kb: DataFrame) -> DataFrame:
    """Rows set, kb_id, overlap, sim: equal sets on either side are compared once, and the entries' told apart afterwards."""
    files = M.representatives(incoming, "id").where(F.size("members") > 0)
    entries = M.representatives(kb, "kb_id").where(F.size("members") > 0)
    found = M.kb_similar(files, entries).join(files.select("id", "set"), "id").drop("id")
    return found.join(entries.select("kb_id", F.col("set").alias("other")), "kb_id").drop("kb_id").join(kb.select("kb_id", F.col("set").alias("other")), "other").drop("other")


_INCOMING = f"""
    f AS (SELECT DISTINCT file_id AS id, source_bucket, body FROM incoming_files),
    fw AS (SELECT id, source_bucket, {sql_tokens('body')} AS w FROM f), fs AS (SELECT id, source_bucket, {sql_runs('w', 5)} AS s FROM fw),
    kw AS (SELECT kb_id, {sql_tokens('body')} AS w FROM kb_entries), ks AS (SELECT kb_id, {sql_runs('w', 5)} AS s FROM kw),
    o AS (SELECT id, kb_id, count(*) AS overlap FROM (SELECT id, unnest(s) AS x FROM fs) JOIN (SELECT kb_id, unnest(s) AS x FROM ks) USING (x) GROUP BY 1, 2),
    p AS (SELECT o.id, o.kb_id, o.overlap, o.overlap / (len(fs.s) + len(ks.s) - o.overlap) AS sim FROM o JOIN fs USING (id) JOIN ks USING (kb_id)),
    b AS (SELECT id, max(sim) AS best_sim, arg_min(kb_id, (-sim, kb_id)) AS best_kb FROM p GROUP BY id),
    m AS (SELECT fs.id AS file_id, fs.source_bucket, b.best_kb, coalesce(b.best_sim, 0e0) AS best_sim,
                 CASE WHEN coalesce(b.best_sim, 0) >= 5e-1 THEN 'EXACT' WHEN coalesce(b.best_sim, 0) >= 2e-1 THEN 'NEAR' ELSE 'NEW' END AS status FROM fs LEFT JOIN b USING (id))"""


def match_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Each incoming file with its best entry, the similarity and the status; of equals the lowest kb_id."""
    incoming, kb = _sides(spark, d)
    files, entries = M.representatives(incoming, "id"), M.representatives(kb, "kb_id")
    # the lowest entry of each set is the one to name
    best = M.kb_similar(files, entries).groupBy("id").agg(F.max(F.struct("sim", (-F.col("kb_id")).alias("k"))).alias("best")).join(files.select("id", "set"), "id").drop("id")
    sim = F.coalesce("best.sim", F.lit(0.0))
    return incoming.select("id", "set", "source_bucket").join(best, "set", "left").select(
        F.col("id").alias("file_id"), "source_bucket", (-F.col("best.k")).alias("best_kb"), sim.alias("best_sim"), T.similarity_class(sim).alias("status")
    )


def incoming_status(spark: SparkSession, d: str, near: float = 0.20) -> DataFrame:
    """Each incoming file with its status only: entries that share less than a status needs aren't compared."""
    incoming, kb = _sides(spark, d)
    files = M.representatives(incoming, "id")
    best = M.kb_above(files, M.representatives(kb, "kb_id"), near).groupBy("id").agg(F.max("sim").alias("sim")).join(files.select("id", "set"), "id").drop("id")
    return incoming.select("set", "source_bucket").join(best, "set", "left").select("source_bucket", T.similarity_class(F.coalesce("sim", F.lit(0.0)), near).alias("status"))


@query(f"WITH {_INCOMING} SELECT id AS file_id, kb_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, kb_id) AS r FROM o) WHERE r <= 20")
def kb_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The twenty entries with the most shared shingles of each file."""
    incoming, kb = _sides(spark, d)
    w = Window.partitionBy("set").orderBy(F.desc("overlap"), "kb_id")
    ranked = _overlapping(incoming, kb).withColumn("r", F.row_number().over(w)).where("r <= 20")
    return ranked.join(incoming.select("id", "set"), "set").select(F.col("id").alias("file_id"), "kb_id", "overlap")


@query(f"WITH {_INCOMING} SELECT file_id, coalesce(best_kb, -1) AS best_kb, best_sim, status FROM m")
def kb_match(spark: SparkSession, d: str) -> DataFrame:
    return match_incoming(spark, d).select("file_id", F.coalesce("best_kb", F.lit(-1)).alias("best_kb"), "best_sim", "status")


@query(f"WITH {_INCOMING}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, kb_id) AS r FROM p) SELECT id AS file_id, array_to_string(list(kb_id ORDER BY r), ',') AS others FROM r WHERE r BETWEEN 2 AND 4 AND sim > 1e-1 GROUP BY id")
def alternates(spark: SparkSession, d: str) -> DataFrame:
    """Second to fourth best entries above a similarity of 0.1."""
    incoming, kb = _sides(spark, d)
    w = Window.partitionBy("set").orderBy(F.desc("sim"), "kb_id")
    ranked = _overlapping(incoming, kb).where("sim > 0.1").withColumn("r", F.row_number().over(w)).where("r between 2 and 4").join(incoming.select("id", "set"), "set")
    return ranked.groupBy(F.col("id").alias("file_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "kb_id"))), lambda x: x.kb_id.cast("string")), ",").alias("others"))


@query(f"WITH {_INCOMING} SELECT status, count(*) AS n FROM m GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return incoming_status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_INCOMING} SELECT source_bucket, count(*) FILTER (WHERE status = 'NEW') AS n_new, count(*) FILTER (WHERE status = 'NEAR') AS n_near, count(*) FILTER (WHERE status = 'EXACT') AS n_exact,
    round(100e0 * count(*) FILTER (WHERE status = 'NEW') / count(*), 6) AS new_percent FROM m GROUP BY 1""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = incoming_status(spark, d).groupBy("source_bucket").pivot("status", ["NEW", "NEAR", "EXACT"]).count().na.fill(0)
    n = F.col("NEW") + F.col("NEAR") + F.col("EXACT")
    return p.select("source_bucket", F.col("NEW").alias("n_new"), F.col("NEAR").alias("n_near"), F.col("EXACT").alias("n_exact"), F.round(100.0 * F.col("NEW") / n, 6).alias("new_percent"))


_CLASSES = f"""
    c AS (SELECT chapter_id, any_value(title) AS title, any_value(content) AS content, any_value(source_file) AS source_file FROM chapters GROUP BY 1),
    cw AS (SELECT chapter_id, coalesce(source_file, '') AS source, list_sort(list_distinct(list_filter(string_split({sql_title("coalesce(title, '')")}, ' '), lambda x: x <> ''))) AS words, {sql_tokens('content', T.STOPWORDS)} AS w FROM c),
    cs AS (SELECT chapter_id, source, words, list_sort({sql_runs('w', 5)}) AS members FROM cw),
    kc AS (SELECT *, CASE WHEN len(members) = 0 THEN 'empty' ELSE array_to_string(words, ' ') || chr(10) || array_to_string(members, chr(10)) END AS class FROM cs),
    k AS (SELECT min(chapter_id) AS id, arg_min(words, chapter_id) AS words, arg_min(members, chapter_id) AS members, min(source) AS low, max(source) AS high, count(*) AS n_members, class FROM kc GROUP BY class),
    ce AS (SELECT id, unnest(members) AS x FROM k),
    co AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM ce a JOIN ce b USING (x) WHERE a.id < b.id GROUP BY 1, 2)"""


#: Both similarities of all pairs of classes that aren't all from one source, whether they share anything or not.
_SIMS = f"""{_CLASSES},
    sims AS (SELECT x.id AS a, y.id AS b,
        CASE WHEN len(x.words) = 0 AND len(y.words) = 0 THEN 1e0 ELSE len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) END AS title_sim,
        CASE WHEN len(x.members) = 0 AND len(y.members) = 0 THEN 1e0 ELSE coalesce(co.n, 0) / (len(x.members) + len(y.members) - coalesce(co.n, 0)) END AS content_sim
      FROM k x JOIN k y ON x.id < y.id AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low) LEFT JOIN co ON co.a = x.id AND co.b = y.id)"""
_STRICT = f"{_SIMS}, strict AS (SELECT * FROM sims WHERE content_sim >= 4e-1 OR (title_sim >= 8e-1 AND content_sim >= 15e-2) OR (title_sim >= 99e-2 AND content_sim >= 1e-1))"


@query(f"WITH {_STRICT} SELECT * FROM strict")
def strict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chapter classes that tell the same; with class_members, every link between chapters."""
    ws = Workspace(spark, "strict")
    return M.strict_pairs(ws.put(M.classes(M.chapter_sets(table(spark, d, "chapters"))), "classes"), ws)


@query(f"""WITH {_CLASSES} SELECT chapter_id, min(chapter_id) OVER (PARTITION BY class) AS class_id,
    min(chapter_id) OVER (PARTITION BY words) AS title_id, min(chapter_id) OVER (PARTITION BY members) AS content_id FROM kc""")
def class_members(spark: SparkSession, d: str) -> DataFrame:
    """The classes that pairs are told by: of equal chapters (all without words of content are one), equal titles, equal contents."""
    keys = M.chapter_sets(table(spark, d, "chapters")).select("chapter_id", "title", "content", F.slice("members", 1, 1).alias("members"))
    return M.class_membership(Workspace(spark, "members").put(keys, "keys"))


_LOOSE = f"""{_CLASSES},
    lt AS (SELECT min(chapter_id) AS id, words AS s, min(source) AS low, max(source) AS high FROM cs WHERE len(words) > 0 GROUP BY words),
    lc AS (SELECT min(chapter_id) AS id, members AS s, min(source) AS low, max(source) AS high FROM cs WHERE len(members) > 0 GROUP BY members),
    ls AS (SELECT 'title' AS kind, * FROM lt UNION ALL SELECT 'content', * FROM lc),
    lu AS (SELECT kind, id, len(s) AS n, low, high, unnest(s) AS x FROM ls),
    loose AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS sim FROM lu a JOIN lu b ON a.kind = b.kind AND a.x = b.x AND a.id < b.id
        WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low) GROUP BY a.kind, a.id, b.id, a.n, b.n)"""


@query(f"WITH {_LOOSE} SELECT kind, a, b, sim FROM loose WHERE sim >= CASE kind WHEN 'title' THEN 5e-1 ELSE 3e-1 END")
def cross_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar titles and of similar contents; with class_members, every link between chapters."""
    ws = Workspace(spark, "loose")
    pairs = M.loose_pairs(ws.put(M.chapter_sets(table(spark, d, "chapters")), "sets"), ws)
    ws.drop("sets")
    return pairs


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Strict links between chapters as edges: classes among each other, members to their class."""
    ws = Workspace(spark, "links")
    sets = ws.put(M.chapter_sets(table(spark, d, "chapters")), "sets")
    known = ws.put(M.classes(sets), "classes")
    pairs = ws.put(M.strict_pairs(known, ws).select("a", "b"), "pairs")
    # members are linked where their class has more than one source, or is linked to another one
    linked = known.where("low <> high").select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    members = M.class_membership(sets).where("class_id <> chapter_id").join(linked.withColumnRenamed("id", "class_id"), "class_id", "left_semi")
    return ws.put(pairs.union(members.select("class_id", "chapter_id")), "edges")


_COMPONENTS = f"""{_STRICT},
    ms AS (SELECT kc.chapter_id, k.id AS class_id, k.low, k.high FROM kc JOIN k USING (class)),
    e0 AS (SELECT a, b FROM strict UNION SELECT class_id, chapter_id FROM ms WHERE class_id <> chapter_id AND (low <> high OR class_id IN (SELECT a FROM strict UNION SELECT b FROM strict))),
    e1 AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
    r(a, b) AS (SELECT a, a FROM e1 UNION SELECT r.a, e1.b FROM r JOIN e1 ON e1.a = r.b),
    comp AS (SELECT a AS chapter_id, min(b) AS component FROM r GROUP BY a)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT chapter_id, component FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_links(spark, d)).select(F.col("vertex").alias("chapter_id"), "component")


_WINNERS = f"""{_COMPONENTS}, sc AS ({TEXT_SQL['chapter_score']}),
    ranked AS (SELECT chapter_id, component, score, row_number() OVER (PARTITION BY component ORDER BY score DESC, chapter_id) AS r FROM comp JOIN sc USING (chapter_id)),
    win AS (SELECT component, max(CASE WHEN r = 1 THEN chapter_id END) AS winner, max(score) AS score, count(*) AS n_members FROM ranked GROUP BY component)"""


def _winners(spark: SparkSession, d: str) -> DataFrame:
    scores = chapter_score(spark, d)
    return components(spark, d).join(scores, "chapter_id").groupBy("component").agg(F.max(F.struct("score", (-F.col("chapter_id")).alias("k"))).alias("best"), F.count("*").alias("n_members")).select(
        "component", (-F.col("best.k")).alias("winner"), F.col("best.score").alias("score"), "n_members"
    )


@query(f"WITH RECURSIVE {_WINNERS} SELECT component, winner, score, n_members FROM win")
def merge_winners(spark: SparkSession, d: str) -> DataFrame:
    """The chapter with the highest score of each component, of equals the lowest."""
    return _winners(spark, d)


@query(f"""WITH RECURSIVE {_WINNERS},
    o AS (SELECT winner AS chapter_id, 0 AS single FROM win UNION ALL SELECT chapter_id, 1 FROM c WHERE chapter_id NOT IN (SELECT chapter_id FROM comp))
    SELECT row_number() OVER (ORDER BY o.single, lower(coalesce({sql_display('c.title')}, '')), o.chapter_id) AS number, o.chapter_id, o.single FROM o JOIN c USING (chapter_id)""")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    """Output order: winners by title, then chapters without a match by title."""
    chapters = table(spark, d, "chapters").select("chapter_id", F.lower(F.coalesce(T.display_title(F.col("title")), F.lit(""))).alias("t")).dropDuplicates(["chapter_id"])
    comp = Workspace(spark, "order").put(components(spark, d), "components")
    best = comp.join(chapter_score(spark, d), "chapter_id").groupBy("component").agg(F.max(F.struct("score", (-F.col("chapter_id")).alias("k"))).alias("b"))
    out = best.select((-F.col("b.k")).alias("chapter_id"), F.lit(0).alias("single")).union(chapters.join(comp, "chapter_id", "left_anti").select("chapter_id", F.lit(1)))
    return number_rows(out.join(chapters, "chapter_id"), F.asc("single"), F.asc("t"), F.asc("chapter_id")).select("number", "chapter_id", "single")


@query("""SELECT least(source_a, source_b) AS source_1, greatest(source_a, source_b) AS source_2, count(*) AS n FROM
    (SELECT DISTINCT source_a, index_a, source_b, index_b FROM chapter_matches WHERE source_a <> source_b) GROUP BY 1, 2""")
def match_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chapter_matches").where("source_a <> source_b").select("source_a", "index_a", "source_b", "index_b").distinct()
    return m.groupBy(F.least("source_a", "source_b").alias("source_1"), F.greatest("source_a", "source_b").alias("source_2")).agg(F.count("*").alias("n"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chapter_matches").where("source_a <> source_b")
    return m.select(F.col("source_a").alias("source_file"), F.col("index_a").alias("chapter_index")).union(m.select("source_b", "index_b")).distinct()


_MATCHED = "mk AS (SELECT source_a AS source_file, index_a AS chapter_index FROM chapter_matches WHERE source_a <> source_b UNION SELECT source_b, index_b FROM chapter_matches WHERE source_a <> source_b)"


@query(f"WITH {_MATCHED} SELECT DISTINCT chapter_id FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.source_file = c.source_file AND mk.chapter_index = c.chapter_index)")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").join(_matched(spark, d), ["source_file", "chapter_index"], "left_anti").select("chapter_id").distinct()


@query(f"""WITH {_MATCHED}, u AS (SELECT DISTINCT c.chapter_id, c.source_file, mk.source_file IS NULL AS alone FROM chapters c LEFT JOIN mk ON mk.source_file = c.source_file AND mk.chapter_index = c.chapter_index)
    SELECT source_file, count(*) AS n_all, count(*) FILTER (WHERE alone) AS n_unique FROM u GROUP BY 1""")
def unique_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of each source, and how many of them no other source matches."""
    c = table(spark, d, "chapters").select("chapter_id", "source_file", "chapter_index").distinct().join(_matched(spark, d).withColumn("there", F.lit(True)), ["source_file", "chapter_index"], "left")
    return c.groupBy("source_file").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("there").isNull(), 1)).alias("n_unique"))


@query(f"""SELECT source_file, count(*) AS n_chapters, round(avg(n), 6) AS mean_chars, max(n) AS most_chars, round(avg(words), 6) AS mean_words
    FROM (SELECT DISTINCT chapter_id, source_file, coalesce(length(content), 0) AS n, len({sql_words('content')}) AS words FROM chapters) GROUP BY 1""")
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of each source with their mean words, and their mean and most characters."""
    c = table(spark, d, "chapters").select("chapter_id", "source_file", F.coalesce(F.length("content"), F.lit(0)).alias("n"), T.word_count(F.col("content")).alias("words")).distinct()
    return c.groupBy("source_file").agg(F.count("*").alias("n_chapters"), F.round(F.avg("n"), 6).alias("mean_chars"), F.max("n").alias("most_chars"), F.round(F.avg("words"), 6).alias("mean_words"))


@query("""SELECT match_id, source_a, index_a, source_b, index_b, score FROM (SELECT *, row_number() OVER (PARTITION BY source_a ORDER BY score DESC, match_id) AS r FROM
    (SELECT DISTINCT match_id, source_a, index_a, source_b, index_b, round(coalesce(title_sim, 0) + content_sim, 6) AS score FROM chapter_matches)) WHERE r <= 10""")
def top_matches(spark: SparkSession, d: str) -> DataFrame:
    """The ten best matches of each source, by the sum of both similarities."""
    m = table(spark, d, "chapter_matches").select("match_id", "source_a", "index_a", "source_b", "index_b", F.round(F.coalesce("title_sim", F.lit(0.0)) + F.col("content_sim"), 6).alias("score")).distinct()
    return m.withColumn("r", F.row_number().over(Window.partitionBy("source_a").orderBy(F.desc("score"), "match_id"))).where("r <= 10").drop("r")
