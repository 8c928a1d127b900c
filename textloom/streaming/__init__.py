"""Streams: conversation events, and files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as T
from textloom.operators import similarity as M

EVENT = "timestamp timestamp, role string, message string, model string"


def tag_events(events: DataFrame) -> DataFrame:
    """Adds the mood of each event's message."""
    return events.withColumn("mood", T.mood(F.col("message")))


def append_events(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Appends events with their mood by day; the same one delivered again within ``late`` counts once."""
    once = tag_events(events).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["timestamp", "role", "message"])
    out = once.withColumn("day", F.to_date("timestamp"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


#: So many events of a log are kept at hand.
KEPT = 500


def kept_events(log: DataFrame, most: int = KEPT) -> DataFrame:
    """The last events of the log (as append_events writes it), by time; of equal times by role and message."""
    return log.orderBy(F.desc("timestamp"), "role", "message").limit(most)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events and users' turns by session; an extension, as logs have one file by process."""
    return events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user")).select("w.start", "w.end", "n", "n_user")


def type_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and window of time, of columns ts, event_type, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def watch_folder(spark: SparkSession, folder: str, kb: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Matches Markdown files with the knowledge base (kb_id, body) as they arrive, and appends the result."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").schema("value string").load(folder).withColumn("path", F.col("_metadata.file_path"))
    entries = kb.select("kb_id", M.hashed(T.shingles(F.col("body"))).alias("members"))

    def match(batch: DataFrame, number: int) -> None:
        new = batch.select(F.col("path").alias("id"), M.hashed(T.shingles(T.front_matter(F.col("value")).getField("body"))).alias("members"))
        best = M.kb_similar(new, entries).groupBy("id").agg(F.max(F.struct("sim", (-F.col("kb_id")).alias("k"))).alias("b"))
        sim = F.coalesce("b.sim", F.lit(0.0))
        rows = new.select("id").join(best, "id", "left").select(F.col("id").alias("path"), (-F.col("b.k")).alias("best_kb"), sim.alias("best_sim"), T.similarity_class(sim).alias("status"))
        # a batch that runs again replaces what it wrote before
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return files.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
