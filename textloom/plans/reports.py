"""What is told about matches, conversations and files: ordered lists, manifests, previews, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.numbering import number_rows
from textloom.plans import chat, matching, versions
from textloom.plans.common import sql_display, sql_name, sql_strip, sql_words, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_cell(col: str, most: int) -> str:
    return f"replace(replace(substring(coalesce({col}, ''), 1, {most}), '|', '\\|'), chr(10), ' ')"


_FILES = f"""{matching._INCOMING},
    fi AS (SELECT file_id, any_value(title) AS title, any_value(len({sql_words('body')})) AS words FROM incoming_files GROUP BY 1),
    fm AS (SELECT m.*, fi.title, fi.words FROM m JOIN fi USING (file_id))"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Each file with its best entry, status, title and words."""
    info = table(spark, d, "incoming_files").groupBy("file_id").agg(F.max("title").alias("title"), F.max(T.word_count(F.col("body"))).alias("words"))
    return matching.match_incoming(spark, d).join(info, "file_id")


@query(f"""WITH {_FILES} SELECT status, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'NEW' THEN -words ELSE -best_sim END, file_id) AS place, file_id,
    CASE WHEN status = 'NEW' THEN {sql_cell('title', 70)} ELSE {sql_cell('title', 50)} END AS title, words, round(best_sim, 6) AS sim FROM fm""")
def status_lists(spark: SparkSession, d: str) -> DataFrame:
    """The files by status: new ones by their words, the others by similarity."""
    f = _files(spark, d).withColumn("rank", F.when(F.col("status") == "NEW", F.col("words").cast("double")).otherwise(F.col("best_sim")))
    title = F.when(F.col("status") == "NEW", T.cell(F.col("title"), 70)).otherwise(T.cell(F.col("title"), 50))
    return number_rows(f, F.desc("rank"), F.asc("file_id"), name="place", by="status").select("status", "place", "file_id", title.alias("title"), "words", F.round("best_sim", 6).alias("sim"))


@query(f"WITH x AS ({matching.SQL['match_matrix']}) SELECT row_number() OVER (ORDER BY n DESC, source_1, source_2) AS place, source_1, source_2, n FROM x")
def matrix_order(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of sources by the number of their matches."""
    return number_rows(matching.match_matrix(spark, d), F.desc("n"), F.asc("source_1"), F.asc("source_2"), name="place")


# Where files of a bucket go, and those of no bucket named here.
BUCKETS = {"from_docx": "docx", "from_epub": "ebooks", "nachlass": "nachlass"}
ELSEWHERE, MAIN = "weitere", "from_hauptwerk"

_BUCKET = f"CASE WHEN source_bucket = '{MAIN}' THEN 'hauptwerk_' || lower(status) ELSE CASE source_bucket " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUCKETS.items()) + f" ELSE '{ELSEWHERE}' END END"


def buckets(files: DataFrame) -> DataFrame:
    """The files that aren't known already, with the bucket they go to: the main work's by status, the others by a map."""
    known = F.create_map(*(F.lit(x) for item in BUCKETS.items() for x in item))
    bucket = F.when(F.col("source_bucket") == MAIN, F.concat(F.lit("hauptwerk_"), F.lower("status"))).otherwise(F.coalesce(known[F.col("source_bucket")], F.lit(ELSEWHERE)))
    return files.where("status <> 'EXACT'").withColumn("bucket", bucket)


@query(f"WITH {_FILES} SELECT {_BUCKET} AS bucket, count(*) AS n, sum(words)::BIGINT AS words FROM fm WHERE status <> 'EXACT' GROUP BY 1")
def bucket_map(spark: SparkSession, d: str) -> DataFrame:
    return buckets(_files(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


_NAME = f"coalesce(nullif({sql_name(sql_display('title'), '_', 60)}, ''), 'untitled')"


@query(f"""WITH {_FILES}, bk AS (SELECT *, {_BUCKET} AS bucket FROM fm WHERE status <> 'EXACT'), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY file_id) AS k FROM bk)
    SELECT bucket, k AS number, bucket || '/' || printf('%04d', k) || '_' || {_NAME} || '.md' AS file, {sql_display('title')} AS title_clean, file_id, words AS word_count, status AS kb_status, round(best_sim, 3) AS kb_best_sim, best_kb AS kb_best_match FROM n""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The files to take in: a running number by bucket, the name it gives, and what they match."""
    numbered = number_rows(buckets(_files(spark, d)), F.asc("file_id"), by="bucket")
    file = F.concat("bucket", F.lit("/"), F.format_string("%04d_", "number"), T.file_name(F.col("title")), F.lit(".md"))
    return numbered.select("bucket", "number", file.alias("file"), T.display_title(F.col("title")).alias("title_clean"), "file_id", F.col("words").alias("word_count"), F.col("status").alias("kb_status"), F.round("best_sim", 3).alias("kb_best_sim"), F.col("best_kb").alias("kb_best_match"))


@query("""WITH w AS (SELECT DISTINCT chapter_id, greatest(1, least(coalesce(word_count, 2), 480)) AS minutes FROM chapters), p AS (SELECT *, CASE WHEN minutes <= 5 THEN 60 WHEN minutes <= 30 THEN 180 ELSE 300 END AS pause FROM w)
    SELECT chapter_id, minutes, pause, greatest(1, minutes * 60 // pause) AS cycles FROM p""")
def clamp_minutes(spark: SparkSession, d: str) -> DataFrame:
    """A length in minutes between 1 and 480 (2 by default), the pause it asks for and the cycles that fit."""
    m = table(spark, d, "chapters").select("chapter_id", T.clamp(F.coalesce("word_count", F.lit(2)), 1, 480).alias("minutes")).distinct()
    m = m.withColumn("pause", T.pause_seconds(F.col("minutes")))
    return m.withColumn("cycles", F.greatest(F.lit(1), F.floor(F.col("minutes") * 60 / F.col("pause")).cast("int")))


@query(f"SELECT DISTINCT chapter_id, {sql_cell('title', 70)} AS title, substring(coalesce(source_file, ''), 1, 30) AS source FROM chapters")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", T.cell(F.col("title"), 70).alias("title"), F.substring(F.coalesce("source_file", F.lit("")), 1, 30).alias("source")).distinct()


_PRINTABLE = sql_strip(r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{feff}]', '', 'g')")


@query(f"SELECT DISTINCT source_id, length({_PRINTABLE}) AS chars, md5({_PRINTABLE}) AS text_md5 FROM source_documents WHERE text IS NOT NULL")
def printable_text(spark: SparkSession, d: str) -> DataFrame:
    t = T.printable(F.col("text"))
    return table(spark, d, "source_documents").where("text is not null").select("source_id", F.length(t).alias("chars"), F.md5(t).alias("text_md5")).distinct()


#: Answers of this kind are weak: they count only where a conversation has no others.
WEAK = "ebook"

_ANSWERS = f"""{chat._TURNS}, k AS (SELECT doc_id, doc_kind FROM documents), a AS (SELECT l.*, k.doc_kind = '{WEAK}' AS weak, bool_or(k.doc_kind <> '{WEAK}') OVER (PARTITION BY conv) AS better FROM l JOIN k USING (doc_id) WHERE place <= 20 AND role = 'assistant'),
    u AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY place) AS k FROM a WHERE NOT (better AND weak)),
    i AS (SELECT conv, count(*) AS n_answers, NOT any_value(better) AS fallback, md5(string_agg('[' || strftime(written_at, '%Y-%m-%d %H:%M:%S') || '] ' || substring(message, 1, 300), chr(10) ORDER BY written_at, doc_id)) AS prompt_md5 FROM u WHERE k <= 5 GROUP BY conv)"""


@query(f"WITH {_ANSWERS} SELECT min(conv) AS conv, min(n_answers) AS n_answers, bool_and(fallback) AS fallback, prompt_md5, count(*) AS n_convs FROM i GROUP BY prompt_md5")
def checked_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What is checked for contradictions: the last five answers of the last twenty turns, weak ones only where there are no others; the same prompt once."""
    kind = table(spark, d, "documents").select("doc_id", (F.col("doc_kind") == WEAK).alias("weak"))
    a = chat.last_turns(spark, d, 20).where("role = 'assistant'").join(kind, "doc_id")
    conv = Window.partitionBy("conv")  # at most twenty turns each
    used = a.withColumn("better", F.max((~F.col("weak")).cast("int")).over(conv)).where("not (better = 1 and weak)").withColumn("k", F.row_number().over(conv.orderBy("place"))).where("k <= 5")
    line = F.concat(F.lit("["), F.date_format("written_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.substring("message", 1, 300))
    lines = used.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("written_at", "doc_id", line.alias("line")))).alias("x"), F.count("*").alias("n_answers"), F.max("better").alias("better"))
    prompts = lines.select("conv", "n_answers", (F.col("better") == 0).alias("fallback"), F.md5(F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("prompt_md5"))
    return prompts.groupBy("prompt_md5").agg(F.min("conv").alias("conv"), F.min("n_answers").alias("n_answers"), F.bool_and("fallback").alias("fallback"), F.count("*").alias("n_convs"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE length({sql_strip('text')}) >= 10) AS n_corrections, count(*) FILTER (WHERE length({sql_strip('text')}) >= 20) AS n_answers FROM documents GROUP BY 1")
def valid_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Texts long enough for a correction (10 characters) and for an answer (20)."""
    n = F.length(T.strip(F.col("text")))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(n >= 10, 1)).alias("n_corrections"), F.count(F.when(n >= 20, 1)).alias("n_answers"))


@query(f"""WITH o AS ({chat.SQL['open_questions']}), t AS (SELECT doc_id, written_at FROM documents), q AS ({chat.TEXT_SQL['search_query']}), n AS ({chat.SQL['not_researched']}),
    two AS (SELECT o.conv, o.doc_id, q.query, row_number() OVER (PARTITION BY o.conv ORDER BY t.written_at, o.doc_id) AS k FROM o JOIN t USING (doc_id) JOIN q USING (doc_id) WHERE o.unsure),
    once AS (SELECT *, row_number() OVER (PARTITION BY conv, query ORDER BY k) AS again FROM two WHERE k <= 2)
    SELECT conv, doc_id, query FROM once WHERE again = 1 AND doc_id IN (SELECT doc_id FROM n)""")
def research_queue(spark: SparkSession, d: str) -> DataFrame:
    """At most two open questions of each conversation, in their order; those tried or researched before still use up a place."""
    docs = table(spark, d, "documents").select("doc_id", "written_at", T.search_query(F.col("text")).alias("query"))
    asked = chat.open_questions(spark, d).where("unsure").join(docs, "doc_id")
    two = asked.withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy("written_at", "doc_id"))).where("k <= 2")
    once = two.withColumn("again", F.row_number().over(Window.partitionBy("conv", "query").orderBy("k"))).where("again = 1")
    return once.join(chat.not_researched(spark, d), "doc_id", "left_semi").select("conv", "doc_id", "query")


@query(f"""WITH {versions._UNIQUE}, p AS (SELECT kb_id, unnest({versions._LINES}) AS line, generate_subscripts({versions._LINES}, 1) AS pos FROM w),
    y AS (SELECT x.base, x.kb_id, p.pos, x.line FROM (SELECT DISTINCT base, kb_id, line FROM x) x JOIN p ON p.kb_id = x.kb_id AND p.line = x.line), r AS (SELECT *, row_number() OVER (PARTITION BY base, kb_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY base, kb_id) AS n FROM y)
    SELECT base, kb_id, max(n) AS n_unique, greatest(max(n) - 20, 0) AS n_more, string_agg(substring(line, 1, 200), chr(10) ORDER BY k) AS preview FROM r WHERE k <= 20 GROUP BY 1, 2""")
def unique_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty lines that only this version has, 200 characters of each, and how many more there are."""
    v = versions.versions(spark, d)
    longest = versions._groups(v).select("base", "longest")
    lines = v.join(longest, "base").select("base", "kb_id", "longest", F.posexplode(versions._lines()).alias("pos", "line"))
    kept = lines.where("kb_id = longest").select("base", "line").distinct()
    own = lines.where("kb_id <> longest").join(kept, ["base", "line"], "left_anti")
    one = Window.partitionBy("base", "kb_id")
    first = own.withColumn("k", F.row_number().over(one.orderBy("pos"))).where("k <= 20").groupBy("base", "kb_id").agg(F.sort_array(F.collect_list(F.struct("k", F.substring("line", 1, 200).alias("t")))).alias("x"))
    counts = own.groupBy("base", "kb_id").agg(F.count("*").alias("n_unique"))
    return counts.join(first, ["base", "kb_id"]).select("base", "kb_id", "n_unique", F.greatest(F.col("n_unique") - 20, F.lit(0)).alias("n_more"), F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("preview"))


@query("""WITH c AS (SELECT doc_id, text, md5('7-' || doc_id) AS h FROM documents WHERE length(text) > 200), m AS (SELECT * FROM c ORDER BY h LIMIT 1)
    SELECT doc_id, substring(text, ('0x' || substring(h, 1, 7))::BIGINT % (length(text) - 199) + 1, 200) AS part FROM m""")
def sampled_window(spark: SparkSession, d: str, seed: int = 7) -> DataFrame:
    """A text drawn by the seed, and a window of 200 characters drawn from it."""
    c = table(spark, d, "documents").where("length(text) > 200").select("doc_id", "text", F.md5(F.concat(F.lit(f"{seed}-"), F.col("doc_id").cast("string"))).alias("h"))
    start = F.conv(F.substring("h", 1, 7), 16, 10).cast("long") % (F.length("text") - 199) + 1
    return c.orderBy("h").limit(1).select("doc_id", F.substr("text", start.cast("int"), F.lit(200)).alias("part"))


_MEDIA = r"'(?:src|href)=\"([^\"]+\.(?:png|jpe?g|gif|webp|svg))\"|!\[[^\]]*\]\(([^()\s]+)\)'"


@query(f"WITH m AS (SELECT DISTINCT kb_id, len(regexp_extract_all(coalesce(body, ''), {_MEDIA})) AS n FROM kb_entries) SELECT count(*) AS n_entries, sum(n)::BIGINT AS n_media, count(*) FILTER (WHERE n > 0) AS n_with_media FROM m")
def media_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that entries show, and entries that show any."""
    n = F.size(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(_MEDIA.strip("'")), 0))
    m = table(spark, d, "kb_entries").select("kb_id", n.alias("n")).distinct()
    return m.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_media"), F.count(F.when(F.col("n") > 0, 1)).alias("n_with_media"))


@query("""WITH m AS (SELECT DISTINCT source_a, index_a, source_b, title_sim, content_sim FROM chapter_matches), b AS (SELECT source_a, index_a, max(content_sim) AS top, max(coalesce(title_sim, 0)) AS title FROM m GROUP BY 1, 2),
    o AS (SELECT source_a, source_b, count(*) AS n FROM m WHERE source_b <> source_a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_a ORDER BY n DESC, source_b) AS k FROM o),
    p AS (SELECT source_a, string_agg(source_b || ':' || n, ',' ORDER BY k) AS partners FROM r WHERE k <= 5 GROUP BY 1)
    SELECT b.source_a AS source, count(*) AS n_chapters, round(avg(top), 6) AS mean_content, round(avg(title), 6) AS mean_title, any_value(p.partners) AS partners FROM b LEFT JOIN p USING (source_a) GROUP BY 1""")
def match_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each source's best similarities by chapter, and the five sources it matches most."""
    m = table(spark, d, "chapter_matches").select("source_a", "index_a", "source_b", "title_sim", "content_sim").distinct()
    b = m.groupBy("source_a", "index_a").agg(F.max("content_sim").alias("top"), F.max(F.coalesce("title_sim", F.lit(0.0))).alias("title"))
    means = b.groupBy("source_a").agg(F.count("*").alias("n_chapters"), F.round(F.avg("top"), 6).alias("mean_content"), F.round(F.avg("title"), 6).alias("mean_title"))
    most = m.where("source_b <> source_a").groupBy("source_a", "source_b").agg(F.count("*").alias("n"))
    ranked = most.withColumn("k", F.row_number().over(Window.partitionBy("source_a").orderBy(F.desc("n"), "source_b"))).where("k <= 5")
    partners = ranked.groupBy("source_a").agg(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", "source_b", F.col("n").cast("string")).alias("t")))).alias("x"))
    return means.join(partners, "source_a", "left").select(F.col("source_a").alias("source"), "n_chapters", "mean_content", "mean_title", F.array_join(F.transform("x", lambda e: e["t"]), ",").alias("partners"))


@query(f"""{'WITH l AS'} (SELECT doc_id, 'Kopf von ' || coalesce(source, '') || chr(10) || '### ' || strftime(written_at, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '### ' || strftime(written_at, '%Y-%m-%d') || ' Ende' AS log FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(log, '\\n(### [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM l)
    SELECT doc_id, unnest(list_transform(parts, lambda x: length(x))) AS chars, generate_subscripts(parts, 1) - 1 AS seq FROM p""")
def log_split(spark: SparkSession, d: str) -> DataFrame:
    """Logs, made of a head and entries with dated headings here, cut at these; part 0 is the head."""
    day = F.date_format("written_at", "yyyy-MM-dd")
    log = F.concat(F.lit("Kopf von "), F.coalesce("source", F.lit("")), F.lit("\n### "), F.date_format("written_at", "yyyy-MM-dd HH:mm"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n### "), day, F.lit(" Ende"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.log_parts(log)).alias("seq", "part")).select("doc_id", "seq", F.length("part").alias("chars"))


_LOW = "lower(coalesce(text, ''))"


@query(f"""SELECT CASE WHEN regexp_matches({_LOW}, '{'|'.join(T.EXCELLENT)}') THEN 'excellent' WHEN regexp_matches({_LOW}, '{'|'.join(T.GOOD)}') THEN 'good' ELSE 'standard' END AS three,
    CASE WHEN regexp_matches({_LOW}, '{'|'.join(T.GOOD)}') THEN 'good' ELSE 'standard' END AS two, count(*) AS n FROM documents GROUP BY 1, 2""")
def route_variants(spark: SparkSession, d: str) -> DataFrame:
    """The earlier rules for the tier of a prompt, with three tiers and with two."""
    return table(spark, d, "documents").groupBy(T.route_tiers(F.col("text")).alias("three"), T.route_two(F.col("text")).alias("two")).agg(F.count("*").alias("n"))


@query(f"""WITH h AS (SELECT doc_id, CASE WHEN starts_with(text, '---') AND strpos(substring(text, 4), '---') > 0 THEN {sql_strip("substring(text, 4, strpos(substring(text, 4), '---') - 1)")} END AS head FROM documents),
    l AS (SELECT doc_id, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS k FROM h WHERE head IS NOT NULL),
    f AS (SELECT doc_id, k, {sql_strip("split_part(line, ':', 1)")} AS field, regexp_replace(regexp_replace({sql_strip("substring(line, strpos(line, ':') + 1)")}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS value FROM l WHERE contains(line, ':'))
    SELECT doc_id, field, arg_max(value, k) AS value FROM f GROUP BY 1, 2""")
def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of the front matter."""
    return table(spark, d, "documents").select("doc_id", F.explode(T.front_matter_fields(F.col("text"))).alias("field", "value"))


@query("SELECT count(*) FILTER (WHERE filename LIKE '%.md') AS n_files, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM embeddings) = 0 AS index_missing FROM (SELECT DISTINCT kb_id, filename FROM kb_entries)")
def index_state(spark: SparkSession, d: str) -> DataFrame:
    """Files of the knowledge base, vectors of the index, and whether it must be built first."""
    files = table(spark, d, "kb_entries").select("kb_id", "filename").distinct().agg(F.count(F.when(F.col("filename").endswith(".md"), 1)).alias("n_files"))
    vectors = table(spark, d, "embeddings").agg(F.count("*").alias("n_vectors"))
    return files.join(F.broadcast(vectors)).withColumn("index_missing", F.col("n_vectors") == 0)  # one row each


_DATED = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}_.+?)(?:_([0-9]+))?\.md$"


@query(rf"""WITH n AS (SELECT DISTINCT kb_id, filename FROM kb_entries WHERE regexp_matches(filename, '{_DATED}')), b AS (SELECT regexp_extract(filename, '{_DATED}', 1) AS base, coalesce(try_cast(regexp_extract(filename, '{_DATED}', 2) AS BIGINT), 0) AS number FROM n)
    SELECT base, count(*) AS n_versions, max(number) AS highest FROM b GROUP BY base""")
def version_names(spark: SparkSession, d: str) -> DataFrame:
    """Posts by the base of their dated file names, without the number behind it."""
    n = table(spark, d, "kb_entries").select("kb_id", "filename").distinct().where(F.col("filename").rlike(_DATED))
    number = F.coalesce(F.expr(rf"try_cast(nullif(regexp_extract(filename, r'{_DATED}', 2), '') as bigint)"), F.lit(0))
    return n.groupBy(F.regexp_extract("filename", _DATED, 1).alias("base")).agg(F.count("*").alias("n_versions"), F.max(number).alias("highest"))


_CLEAN = sql_strip(r"regexp_replace(regexp_replace(body, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '(?m)^(Vorherige Seite|Nächste Seite|Start|Inhaltsverzeichnis)[ \t]*$', '', 'g')")


@query(f"SELECT DISTINCT kb_id, length({_CLEAN}) AS chars, md5({_CLEAN}) AS text_md5 FROM kb_entries WHERE body IS NOT NULL")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    t = T.clean_lines(F.col("body"))
    return table(spark, d, "kb_entries").where("body is not null").select("kb_id", F.length(t).alias("chars"), F.md5(t).alias("text_md5")).distinct()


_PATH = r"nullif(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), 'uploads/([0-9]{4}/[0-9]{2}/.+)$', 1), '')"


@query(rf"WITH l AS (SELECT kb_id, unnest(regexp_extract_all(body, 'https?://[^\s\x22\x27<>)]+', 0)) AS url FROM (SELECT DISTINCT kb_id, body FROM kb_entries)) SELECT DISTINCT kb_id, url, {_PATH} AS upload FROM l")
def upload_paths(spark: SparkSession, d: str) -> DataFrame:
    """Links in the entries with the path below uploads."""
    links = table(spark, d, "kb_entries").select("kb_id", F.explode(F.regexp_extract_all("body", F.lit(r"https?://[^\s\"'<>)]+"), 0)).alias("url")).distinct()
    return links.select("kb_id", "url", F.nullif(F.regexp_extract(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), r"uploads/([0-9]{4}/[0-9]{2}/.+)$", 1), F.lit("")).alias("upload"))
