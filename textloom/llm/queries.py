"""The problems' queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import components, forms, history, leaks, markup, mixture, pieces, quality, subjects, survivors
from textloom.llm.tables import table, texts

Query = Callable[[SparkSession, str], DataFrame]


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Language, statistics, outlier score and class of every text."""
    return quality.classify(texts(spark, d, "source_documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_statistics(spark, d).where("text_class <> 'prose'").select("source_id", "text_class").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items = markup.text_items(texts(spark, d, "chapters"), texts(spark, d, "kb_entries"))
    return markup.read_markup(items, clean=False).select("origin", "item_id", F.explode("markup").alias("markup")).distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean texts, a repeated row once."""
    items = markup.text_items(texts(spark, d, "chapters"), texts(spark, d, "kb_entries"))
    out = markup.read_markup(items)
    return out.groupBy("origin", "item_id", F.xxhash64("text").alias("h")).agg(F.first("markup").alias("markup"), F.first("text").alias("text")).drop("h")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_long(pieces.chapter_items(texts(spark, d, "chapters"), texts(spark, d, "segmented_sources")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1").select("origin", "item_id", "chapter_index").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of the long contents, without the texts that fit as they are; a repeated row counts once."""
    return _pieces(spark, d).where("n_pieces > 1").distinct()


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Do the pieces of each long content cover it, within the limit and with the overlap asked for."""
    p = _pieces(spark, d).where("n_pieces > 1").distinct()
    back = F.when(F.col("piece_no") > 0, F.col("overlap").between(pieces.OVERLAP - pieces.OVERLAP // 5, pieces.OVERLAP + pieces.OVERLAP // 5)).otherwise(F.col("overlap") == 0)
    return p.groupBy("origin", "item_id", "chapter_index").agg(
        F.sum(F.col("end") - F.col("start") - F.col("overlap")).alias("covered"), F.max(F.length("text")).alias("longest"), F.bool_and(back & (F.length("text") == F.col("end") - F.col("start"))).alias("overlapping")
    ).select("origin", "item_id", "chapter_index", "covered", (F.col("longest") <= pieces.LIMIT).alias("within"), "overlapping")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_files(texts(spark, d, "kb_entries"), texts(spark, d, "incoming_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = forms.text_items(texts(spark, d, "chapters"), texts(spark, d, "source_documents"))
    return forms.affected(items)


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text's form by its hash and length, and how it was affected."""
    items = forms.text_items(texts(spark, d, "chapters"), texts(spark, d, "source_documents"))
    return forms.normalise(items).select("origin", "item_id", "char_kinds", F.length("form").alias("form_chars"), F.md5("form").alias("form_md5")).distinct()


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return components.chapter_groups(table(spark, d, "chapter_matches"), table(spark, d, "chapters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "chapters"), _groups(spark, d), table(spark, d, "source_trust"))


def p6_judged(spark: SparkSession, d: str) -> DataFrame:
    """Like p6_found, but chosen among the values that the quality model judges true."""
    return survivors.judged(table(spark, d, "chapters"), _groups(spark, d), table(spark, d, "source_trust"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The values that each group's record takes over."""
    r = survivors.records(table(spark, d, "chapters"), _groups(spark, d), table(spark, d, "source_trust"))
    return r.select("group_id", F.md5("content").alias("content_md5"), "score", "source_file")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return survivors.records(table(spark, d, "chapters"), _groups(spark, d), table(spark, d, "source_trust"))


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    return survivors.source_quality(table(spark, d, "chapters"), _groups(spark, d), table(spark, d, "source_trust"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(texts(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that hold a passage of it, nought included."""
    found = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return table(spark, d, "eval_items").select("item_id", "suite").distinct().join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    return mixture.mix(texts(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixture.mix(texts(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources' shares of the sum of the shares, their caps and the distinct texts they have."""
    report = mixture.mix(texts(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return report.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", F.round("attainable_share", 9).alias("attainable_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(texts(spark, d, "documents"), table(spark, d, "subject_samples"), table(spark, d, "subject_areas"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p10_found(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_clean, p3_found, p3_pieces, p3_coverage, p4_found, p5_found, p5_forms, p6_found, p6_judged, p6_values, p6_records, p6_sources, p7_found, p8_found, p8_items, p9_mix, p9_shares, p9_sources, p10_found, p10_composition)}
