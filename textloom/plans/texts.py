"""Queries of one text at a time: titles, names, counts, signals, scores, pages, moods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.numbering import number_rows
from textloom.plans.common import S, W, sql_display, sql_list, sql_name, sql_runs, sql_strip, sql_title, sql_tokens, sql_words, table
from textloom.session import spread

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT DISTINCT chapter_id, title, {sql_title('title')} AS normal FROM chapters")
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", "title", T.normal_title(F.col("title")).alias("normal")).distinct()


@query(
    f"SELECT DISTINCT chapter_id, {sql_display('title')} AS display, {sql_display('title', True)} AS one_line, "
    f"coalesce(nullif({sql_name(sql_display('title'), '_', 60)}, ''), 'untitled') AS file_name FROM chapters"
)
def clean_title(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "chapters").select("chapter_id", T.display_title(t).alias("display"), T.display_title(t, one_line=True).alias("one_line"), T.file_name(t).alias("file_name")).distinct()


@query(
    f"""SELECT DISTINCT kb_id, strftime(written_at, '%Y-%m-%d') || '_' || coalesce(nullif({sql_name("coalesce(title, '')", '-', 80)}, ''), 'post-' || kb_id) || '.md' AS slug FROM kb_entries"""
)
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_entries").select("kb_id", T.slug(F.col("title"), F.col("kb_id"), F.date_format("written_at", "yyyy-MM-dd")).alias("slug")).distinct()


_IMPORT = f"""substring(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9\\x{{00c0}}-\\x{{017f}}\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{0085}}-]', '', 'g'), '{S}+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"""


@query(f"""
    WITH f AS (SELECT DISTINCT file_id, filename, body, CASE source_bucket WHEN 'from_hauptwerk' THEN 'Hauptwerk' WHEN 'from_docx' THEN 'Docx' WHEN 'nachlass' THEN 'Nachlass' ELSE 'imported' END AS prefix, {_IMPORT} AS safe FROM incoming_files),
    n AS (SELECT file_id, body, prefix || '_' || CASE WHEN safe = '' THEN regexp_replace(filename, '\\.[^.]*$', '') ELSE safe END AS stem FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY file_id) AS k FROM n)
    SELECT file_id, stem || CASE WHEN k > 1 THEN '_' || substring(md5(substring(coalesce(body, ''), 1, 500)), 1, 6) ELSE '' END || '.md' AS name FROM r""")
def import_names(spark: SparkSession, d: str) -> DataFrame:
    """Names for import: prefix by bucket; where a name is taken already, with a digest of the body's beginning."""
    f = table(spark, d, "incoming_files").select("file_id", "filename", "title", "source_bucket", F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("start")).distinct()
    prefix = F.coalesce(F.create_map(*(F.lit(x) for x in ("from_hauptwerk", "Hauptwerk", "from_docx", "Docx", "nachlass", "Nachlass")))[F.col("source_bucket")], F.lit("imported"))
    safe = T.import_title(F.col("title"))
    stem = F.concat(prefix, F.lit("_"), F.when(safe == "", F.regexp_replace("filename", r"\.[^.]*$", "")).otherwise(safe))
    named = f.withColumn("stem", stem)
    first = named.groupBy("stem").agg(F.min("file_id").alias("first"))
    taken = F.when(F.col("file_id") > F.col("first"), F.concat(F.lit("_"), F.substring(F.md5("start"), 1, 6))).otherwise("")
    return named.join(first, "stem").select("file_id", F.concat("stem", taken, F.lit(".md")).alias("name"))


@query("SELECT CASE WHEN filename LIKE 'BRW-Essenz\\_%' ESCAPE '\\' THEN 'essenz' WHEN regexp_matches(filename, '^[0-9]{4}-[0-9]{2}-[0-9]{2}_') THEN 'blog' ELSE 'other' END AS kind, count(*) AS n FROM kb_entries GROUP BY 1")
def kind_case(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("filename").startswith("BRW-Essenz_"), "essenz").when(F.col("filename").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_"), "blog").otherwise("other")
    return table(spark, d, "kb_entries").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""
    WITH t AS (SELECT doc_id, text, CASE WHEN starts_with(text, '---') THEN strpos(substring(text, 4), chr(10) || '---') ELSE 0 END AS e FROM documents),
    p AS (SELECT doc_id, CASE WHEN e > 0 THEN regexp_extract(substring(text, 4, e - 1), '(?m)^[ \t]*title:[ \t]*[''"]?([^''"\n]+?)[''"]?[ \t]*$', 1) END AS title,
                 CASE WHEN e > 0 THEN regexp_replace(substring(text, e + 7), '^\n+', '') ELSE text END AS body FROM t)
    SELECT doc_id, nullif(trim(title), '') AS title, coalesce(length(body), -1) AS body_chars, md5(body) AS body_md5, nullif(trim(regexp_extract(body, '(?m)^#[ \t]+(.+)$', 1)), '') AS heading FROM p""")
def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", T.front_matter(F.col("text")).alias("x"))
    return p.select("doc_id", "x.title", F.coalesce(F.length("x.body"), F.lit(-1)).alias("body_chars"), F.md5("x.body").alias("body_md5"), T.first_heading(F.col("x.body")).alias("heading"))


@query(f"SELECT DISTINCT chapter_id, coalesce(word_count, -1) AS said, len({sql_words('content')}) AS counted FROM chapters")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", F.coalesce("word_count", F.lit(-1)).alias("said"), T.word_count(F.col("content")).alias("counted")).distinct()


@query(f"SELECT DISTINCT chapter_id, substring({sql_title(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}, 1, 60) || ' | ' || substring(lower(array_to_string({sql_words('content')}[1:30], ' ')), 1, 200) AS fingerprint FROM chapters")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", T.fingerprint(F.col("title"), F.col("content")).alias("fingerprint")).distinct()


@query("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(f"""
    WITH t AS (SELECT DISTINCT chapter_id, content FROM chapters), w AS (SELECT chapter_id, {sql_tokens('content')} AS w, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '{S}+'), lambda x: x <> '') AS v FROM t)
    SELECT chapter_id, len({sql_runs('w', 5)}) AS n_shingles, len({sql_runs('w', 5, 'words')}) AS n_loose, len({sql_runs('v', 3)}) AS n_plain FROM w""")
def shingles(spark: SparkSession, d: str) -> DataFrame:
    """Set sizes of the three dialects of word runs."""
    c = F.col("content")
    return spread(table(spark, d, "chapters")).select("chapter_id", F.size(T.shingles(c)).alias("n_shingles"), F.size(T.shingles(c, short="words")).alias("n_loose"), F.size(T.plain_shingles(c)).alias("n_plain")).distinct()


@query(f"""
    WITH w AS (SELECT {sql_tokens('body')} AS w FROM kb_entries), s AS (SELECT unnest({sql_runs('w', 5)}) AS s FROM w)
    SELECT count(*) AS n_shingles, count(DISTINCT s) AS n_distinct FROM s""")
def shingle_cardinality(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "kb_entries")).select(F.explode(T.shingles(F.col("body"))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_shingles"), F.count("*").alias("n_distinct"))


_T = "coalesce(text, '')"
_LINES = f"string_split({_T}, chr(10))"


def _count(sign: str) -> str:
    return f"(length({_T}) - length(replace({_T}, {sign}, '')))"


def _some(pattern: str) -> str:
    return f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{pattern}')))"


_SIGNALS = f"""SELECT DISTINCT source_id, len({_LINES}) AS n_lines, length({_T}) AS n_chars, len({sql_words('text')}) AS n_words,
    len(list_distinct(regexp_extract_all({_T}, '(?s).'))) AS unique_chars,
    {_some(S + '{4,}[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{0085}]')} AS ws_4plus, {_some(S + '{8,}')} AS ws_8plus, {_some(S + '{16,}')} AS ws_16plus,
    {_some('^' + S + '*$')} AS empty_lines, round({_some('^' + S + '*$')} / len({_LINES}), 3) AS empty_ratio,
    len(regexp_extract_all({_T}, '&(?:nbsp|amp|lt|gt|quot|#[0-9]+);')) AS html_entities,
    {_count(chr(39) + '—' + chr(39))} AS em_dashes, {_count(chr(39) + '–' + chr(39))} AS en_dashes,
    {_count(chr(39) + '“' + chr(39))} + {_count(chr(39) + '”' + chr(39))} AS smart_quotes_d, {_count(chr(39) + '‘' + chr(39))} + {_count(chr(39) + '’' + chr(39))} AS smart_quotes_s,
    {_count('chr(160)')} AS nbsp_unicode, {_count(chr(39) + '…' + chr(39))} AS ellipsis, {_count('chr(9)')} AS tabs, signals FROM source_documents"""


@query(f"""WITH s AS ({_SIGNALS}) SELECT * EXCLUDE (signals), CASE WHEN signals IS NULL THEN 'filled' WHEN signals.n_chars = n_chars AND signals.n_words = n_words AND signals.n_lines = n_lines AND signals.unique_chars = unique_chars THEN 'kept' ELSE 'mended' END AS state FROM s""")
def quality_signals(spark: SparkSession, d: str) -> DataFrame:
    """All signals of each text, and whether the stored ones were missing, right or stale."""
    s = spread(table(spark, d, "source_documents")).select("source_id", "signals", T.signals(F.col("text")).alias("s"))
    same = F.coalesce((F.col("signals.n_chars") == F.col("s.n_chars")) & (F.col("signals.n_words") == F.col("s.n_words")) & (F.col("signals.n_lines") == F.col("s.n_lines")) & (F.col("signals.unique_chars") == F.col("s.unique_chars")), F.lit(False))
    return s.select("source_id", "s.*", F.when(F.col("signals").isNull(), "filled").when(same, "kept").otherwise("mended").alias("state")).distinct()


_NORM = "(1000e0 / greatest(n_words, 1))"
_WS = f"((ws_16plus * 5e0 + ws_8plus * 2e0 + ws_4plus * 3e-1 + tabs * 5e-1) * {_NORM})"
_UNI = f"((em_dashes * 5e-1 + en_dashes * 3e-1 + smart_quotes_d * 2e-1 + smart_quotes_s * 2e-1 + nbsp_unicode * 5e-1 + ellipsis * 3e-1) * {_NORM})"
_STRUCTURE = "(CASE WHEN empty_ratio BETWEEN 1e-1 AND 4e-1 THEN 10e0 WHEN empty_ratio BETWEEN 5e-2 AND 55e-2 THEN 5e0 ELSE 2e0 END)"
_PENALTY = f"(html_entities * 3e-1 * {_NORM})"
_SCORE = f"({_WS} + {_UNI} + {_STRUCTURE} - {_PENALTY})"


@query(f"WITH s AS ({_SIGNALS}) SELECT source_id, round({_WS}, 6) AS ws_fidelity, round({_UNI}, 6) AS uni_fidelity, {_STRUCTURE} AS structure_fidelity, round({_PENALTY}, 6) AS penalty, round({_SCORE}, 6) AS aggregate FROM s")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    s = spread(table(spark, d, "source_documents")).select("source_id", T.signals(F.col("text"), characters=False).alias("s")).distinct()
    p = s.select("source_id", T.score_parts(F.col("s")).alias("p"))
    return p.select("source_id", *(F.round(f"p.{c}", 6).alias(c) for c in ("ws_fidelity", "uni_fidelity")), "p.structure_fidelity", *(F.round(f"p.{c}", 6).alias(c) for c in ("penalty", "aggregate")))


_CHAPTER_SIGNALS = _SIGNALS.replace("source_id", "chapter_id").replace(", signals FROM source_documents", " FROM (SELECT chapter_id, content AS text FROM chapters)")


@query(f"WITH s AS ({_CHAPTER_SIGNALS}) SELECT chapter_id, round({_SCORE} + least(5e0, n_words / 200e0), 6) AS score FROM s")
def chapter_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of a chapter, with the bonus for length."""
    s = spread(table(spark, d, "chapters")).select("chapter_id", T.signals(F.col("content"), characters=False).alias("s")).distinct()
    return s.select("chapter_id", F.round(T.score_parts(F.col("s"), volume=True).getField("aggregate"), 6).alias("score"))


@query(f"WITH s AS ({_SIGNALS}), q AS (SELECT source_id, round({_SCORE}, 6) AS score FROM s) SELECT source_id, score, row_number() OVER (ORDER BY score DESC, source_id) AS rank FROM q")
def quality_rank(spark: SparkSession, d: str) -> DataFrame:
    q = quality_score(spark, d).select("source_id", F.col("aggregate").alias("score"))
    return number_rows(q, F.desc("score"), F.asc("source_id"), name="rank")


@query(f"SELECT source, count(*) AS n_all, sum(CASE WHEN length({sql_strip('text')}) >= 50 THEN 1 ELSE 0 END)::BIGINT AS n_long FROM documents GROUP BY 1")
def min_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_all"), F.sum(F.when(F.length(T.strip(F.col("text"))) >= 50, 1).otherwise(0)).alias("n_long"))


@query(r"""
    WITH l AS (SELECT kb_id, unnest(regexp_extract_all(body, '(?:href|src)="([^"]+)"', 1)) AS url FROM (SELECT DISTINCT kb_id, body FROM kb_entries))
    SELECT kb_id, url, nullif(regexp_extract(url, '^https?://([^/?#:]+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '') AS path FROM l GROUP BY ALL""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Links of the entries' HTML, with host and path."""
    links = table(spark, d, "kb_entries").select("kb_id", F.explode(F.regexp_extract_all("body", F.lit(r'(?:href|src)="([^"]+)"'), 1)).alias("url")).distinct()
    return links.select("kb_id", "url", F.nullif(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1), F.lit("")).alias("host"), F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), F.lit("")).alias("path"))


def sql_page(col: str) -> str:
    t = f"regexp_replace({col}, '(?i)</(p|div|h[1-6]|li|br|pre)>', chr(10), 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#160;", " ")):
        t = f"replace({t}, '{entity}', '{sign}')"
    return t


@query(f"SELECT DISTINCT kb_id, md5({sql_page('body')}) AS text_md5, length({sql_page('body')}) AS text_chars FROM kb_entries WHERE body IS NOT NULL")
def page_text_basic(spark: SparkSession, d: str) -> DataFrame:
    t = T.page_basic(F.col("body"))
    return table(spark, d, "kb_entries").where("body is not null").select("kb_id", F.md5(t).alias("text_md5"), F.length(t).alias("text_chars")).distinct()


_BODY = "CASE WHEN regexp_matches(h, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(h, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE h END"
_CSS = r"'^\s*(@(page|media|font|import)|[{}])|margin-|padding-|font-size:|font-family:|color:\s*#'"


@query(f"""
    WITH a AS (SELECT DISTINCT kb_id, regexp_replace(regexp_replace(regexp_replace(body, '(?is)<head\\b[^>]*>.*?</head>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>', '', 'g') AS h FROM kb_entries WHERE body IS NOT NULL),
    b AS (SELECT kb_id, {sql_page('(' + _BODY + ')')} AS t FROM a),
    c AS (SELECT kb_id, {sql_strip("regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, " + _CSS + ")), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS t FROM b)
    SELECT kb_id, md5(t) AS text_md5, length(t) AS text_chars FROM c""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "kb_entries").where("body is not null").select("kb_id", T.page_text(F.col("body")).alias("t")).distinct()
    return p.select("kb_id", F.md5("t").alias("text_md5"), F.length("t").alias("text_chars"))


@query(f"""
    WITH a AS (SELECT DISTINCT kb_id, body AS h, {sql_strip("regexp_replace(regexp_extract(body, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]+>', '', 'g')")} AS g,
        list_transform(regexp_extract_all(body, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {sql_strip("regexp_replace(x, '<[^>]+>', '', 'g')")}) AS p FROM kb_entries WHERE body IS NOT NULL)
    SELECT kb_id, coalesce(CASE WHEN length(g) BETWEEN 3 AND 200 THEN g END, list_filter(p, lambda x: length(x) BETWEEN 3 AND 150 AND NOT regexp_matches(x, '@page|margin-|font-'))[1], nullif({sql_strip("regexp_extract(h, '(?i)<title[^>]*>([^<]+)</title>', 1)")}, '')) AS title FROM a""")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_entries").where("body is not null").select("kb_id", T.page_title(F.col("body")).alias("title")).distinct()


@query(f"""SELECT DISTINCT file_id, CASE WHEN length(coalesce(body, '')) <= 300 THEN coalesce(body, '') ELSE regexp_replace(substring(body, 1, 300), '(?s) [^ ]*$', '') END AS query FROM incoming_files""")
def query_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "incoming_files").select("file_id", T.guard(F.col("body")).alias("query")).distinct()


def _mood_sql() -> str:
    low = "lower(coalesce(text, ''))"
    score = {m: "(" + " + ".join(f"contains({low}, '{w}')::INT" for w in words) + ")" for m, words in T.MOODS.items()}
    most = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {most} = 0 THEN 'neutral' " + " ".join(f"WHEN {s} = {most} THEN '{m}'" for m, s in score.items()) + " END"


@query(f"SELECT doc_id, {_mood_sql()} AS mood FROM documents")
def mood(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", T.mood(F.col("text")).alias("mood"))


_MARKS = " + ".join(f"contains(lower({_T}), '{m}')::INT" for m in T.FACTUAL)


@query(f"""SELECT doc_id, ({_MARKS}) >= 2 AND (length({_T}) - length(replace({_T}, '...', ''))) / 3 + (length({_T}) - length(replace({_T}, '---', ''))) / 3 + length({_T}) - length(replace({_T}, '*', '')) + len(regexp_extract_all({_T}, '[A-Z]\\s[A-Z]\\s[A-Z]')) < 3 AS too_factual FROM documents""")
def register_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.too_factual(F.col("text")).alias("too_factual"))


@query(f"SELECT CASE WHEN regexp_matches(lower({_T}), '{'|'.join(T.EXCELLENT)}') THEN 'excellent' ELSE 'standard' END AS tier, count(*) AS n FROM documents GROUP BY 1")
def route_tier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.route(F.col("text")).alias("tier")).agg(F.count("*").alias("n"))


@query(f"""
    WITH q AS (SELECT doc_id, {_T} AS t, list_filter(list_transform(regexp_split_to_array(regexp_replace({sql_strip(_T)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: contains(s, '?') AND length(s) BETWEEN 11 AND 150) AS asked FROM documents)
    SELECT doc_id, coalesce(asked[1], CASE WHEN length(t) <= 150 THEN {sql_strip('t')} ELSE {sql_strip("regexp_replace(substring(t, 1, 150), '(?s) [^ ]*$', '')")} END) AS query FROM q""")
def search_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.search_query(F.col("text")).alias("query"))


@query("""SELECT doc_id, strftime(written_at, '%H:%M') AS clock, replace(substring(coalesce(text, ''), 1, 50), chr(10), ' ') AS short, substring(coalesce(text, ''), 1, 300) AS preview,
    CASE WHEN length(text) > 2000 THEN '...' || substring(text, length(text) - 1999) ELSE coalesce(text, '') END AS tail FROM documents""")
def turn_preview(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id", F.date_format("written_at", "HH:mm").alias("clock"), F.replace(F.substring(t, 1, 50), F.lit("\n"), F.lit(" ")).alias("short"), F.substring(t, 1, 300).alias("preview"),
        F.when(F.length(t) > 2000, F.concat(F.lit("..."), F.right(t, F.lit(2000)))).otherwise(t).alias("tail"),
    )


@query("""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, len(string_split(t, chr(10))) AS n_lines, len(regexp_split_to_array(trim(t, ' ' || chr(10) || chr(9) || chr(13)), '[.!?]\\s+')) AS n_sentences FROM t""")
def line_and_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(F.split(t, "\n")).alias("n_lines"), F.size(F.split(F.trim(t, F.lit(" \n\t\r")), r"(?<=[.!?])\s+")).alias("n_sentences"))
