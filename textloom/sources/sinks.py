"""Writers. All go through Spark's commit protocol, so a job that fails leaves no half-written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def front_matter(fields: dict[str, Column]) -> Column:
    """Front matter with the fields that aren't null, values quoted."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), T.yaml_value(c.cast("string")), F.lit('"'))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def distinct_names(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Names that are taken already get the row's place among their likes before the ending."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_k", k).withColumn(name, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.regexp_replace(F.col(name), r"(?s)^(.*?)(\.[^.]*)?$", F.concat(F.lit("$1_"), F.col("_k").cast("string"), F.lit("$2"))))).drop("_k")


def listed(values: Column) -> Column:
    """A list of quoted values in brackets; null of an empty or null list."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), T.yaml_value(v), F.lit('"')))
    return F.when(F.size(values) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def head(fields: dict[str, Column], *more: Column) -> Column:
    """Front matter of lines ``key: value`` for the values that aren't null, as they are, and of further lines."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines, *more), F.lit("\n---\n\n"))


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), T.yaml_value(c.cast("string")), F.lit('"'))


def write_posts(posts: DataFrame, path: str) -> None:
    """Posts (id, title, date, status, body, and slug, categories and tags where there are) as a table of file names and Markdown texts."""
    have = lambda name: F.col(name) if name in posts.columns else F.lit(None)
    named = posts.withColumn("name", T.slug(F.col("title"), F.col("id"), F.col("date")))
    fields = {"title": quote(F.col("title")), "date": quote(F.col("date")), "status": quote(F.col("status")), "wordpress_id": F.col("id"), "slug": quote(F.nullif(have("slug").cast("string"), F.lit("")))}
    lists = {name: listed(F.col(name)) for name in ("categories", "tags") if name in posts.columns}
    distinct_names(named, "name", F.col("id")).select("name", F.concat(head({**fields, **lists}), F.coalesce("body", F.lit(""))).alias("text")).write.mode("overwrite").parquet(path)


def merged_texts(winners: DataFrame) -> DataFrame:
    """Rows name, text of merged chapters (number, title, content, source_file, word_count, score, alternates).

    alternates is an array of structs source_file, title, word_count, score; a title that
    differs from the chapter's own is told.
    """
    shown = T.display_title(F.col("title"))
    alternate = lambda a: F.concat_ws(
        "\n", F.concat(F.lit("  - file: "), a["source_file"]), F.when(T.display_title(a["title"]) != shown, F.concat(F.lit("    title_in_source: "), quote(a["title"]))),
        F.concat(F.lit("    words: "), a["word_count"].cast("string")), F.concat(F.lit("    score: "), F.format_string("%.2f", a["score"])),
    )
    others = F.when(F.size("alternates") > 0, F.concat(F.lit("alternate_sources:\n"), F.array_join(F.transform("alternates", alternate), "\n")))
    fields = {"title": quote(shown), "original_title_in_source": quote(F.col("title")), "source_file": F.col("source_file"), "word_count": F.col("word_count"), "quality_score": F.format_string("%.2f", "score")}
    name = F.concat(F.format_string("m%04d_", F.col("number").cast("int")), T.file_name(F.col("title")), F.lit(".md"))
    return winners.select(name.alias("name"), F.concat(head(fields, others), F.lit("# "), shown, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("text"))


def write_merged(winners: DataFrame, path: str) -> None:
    merged_texts(winners).write.mode("overwrite").parquet(path)


def essence_texts(chapters: DataFrame, source: str = "textloom") -> DataFrame:
    """Rows bucket, name, text of chapters (bucket, number, title, content, source_file, chapter_index, word_count, status, sim, best_match)."""
    shown = T.display_title(F.col("title"))
    fields = {
        "title": quote(shown), "source": F.lit(f'"{source}"'), "source_file": quote(F.col("source_file")), "source_index": F.col("chapter_index"), "word_count": F.col("word_count"),
        "kb_match_status": quote(F.col("status")), "kb_best_sim": F.format_string("%.2f", "sim"), "kb_best_match": quote(F.col("best_match")), "original_title_in_source": F.when(F.col("title") != shown, quote(F.col("title"))),
    }
    name = F.concat(F.format_string("%04d_", F.col("number").cast("int")), T.file_name(F.col("title")), F.lit(".md"))
    return chapters.select("bucket", name.alias("name"), F.concat(head(fields), F.lit("# "), shown, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("text"))


def write_essence(chapters: DataFrame, path: str) -> None:
    """The chapters by bucket; only the buckets that occur are replaced."""
    write_by_bucket(essence_texts(chapters), path)


def write_manifest(df: DataFrame, path: str) -> None:
    """The manifest as lines of JSON, and beside it the counts by bucket and status."""
    df.write.mode("overwrite").json(f"{path}/manifest")
    df.groupBy("bucket", "kb_status").agg(F.count("*").alias("n"), F.sum("word_count").alias("words")).coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def report_lines(df: DataFrame, title: str, columns: dict[str, Column], *order: Column) -> DataFrame:
    """Rows place, line: a report in Markdown, its heading and table head before a row for each of the table's, in order."""
    from textloom.operators.numbering import number_rows

    cells = [F.when(c.isNull(), "-").otherwise(T.cell(c.cast("string"), 200)) for c in columns.values()]
    rows = number_rows(df, *order, name="place").select("place", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("place").cast("string"), *cells), F.lit(" |")).alias("line"))
    top = [(-3, f"# {title}"), (-2, ""), (-1, f"| # | {' | '.join(columns)} |"), (0, "|---" * (len(columns) + 1) + "|")]
    return df.sparkSession.createDataFrame(top, "place long, line string").unionByName(rows)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines in order, as text."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def write_by_bucket(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """A bucket a directory; only the buckets that occur are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def append_log(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def replace_chunks(chunks: DataFrame, path: str) -> None:
    """The whole collection anew."""
    chunks.write.mode("overwrite").parquet(path)
