"""Event-time windows and job and change feeds; each works on batches and, with a watermark, on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_instant(events: DataFrame, ts: str = "ts") -> DataFrame:
    """The time column as an instant, whatever zone-less type the file gave it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def watermarked(events: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return events.withWatermark(ts, delay) if delay else events


def tumbling(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    """start, event_type, n, total."""
    rows = watermarked(as_instant(events), "ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, delay: str | None = None) -> DataFrame:
    rows = watermarked(as_instant(events), "ts", delay).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    rows = watermarked(as_instant(events), "ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def changed_sources(feed: DataFrame, stored: DataFrame, delay: str = "1 day") -> DataFrame:
    """Of a stream of (source, content_hash, ts) each version once, if it differs from the stored fingerprint."""
    fresh = feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source", "content_hash"])
    known = stored.select("source", F.col("content_hash").alias("stored"))
    return fresh.join(known, "source", "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("content_hash"))).drop("stored")


def job_feed(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Runs ``handle`` on every batch of new job files in order of priority and creation; stop and start again to pause."""

    def batch(df: DataFrame, number: int) -> None:
        handle(df.orderBy("priority", "created_at", "job_id"), number)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(changes: DataFrame) -> DataFrame:
    """job_id, status, changes of a stream of (job_id, seq, status): the running fold of ``jobs.fold_states``."""
    return changes.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("changes"))
