"""Structured Streaming forms of the event rules; the batch forms are in operators.activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.activity import CLICK_ZONE, DAY_SECONDS, day_in


def click_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """One row a work, visitor and Taipei day. State is kept until the watermark passes the day's events."""
    visitor = F.sha2(F.concat_ws(":", F.col("work_id").cast("string"), F.col("visitor").cast("string")), 256)
    rows = events.withWatermark("ts", late).select("ts", "work_id", visitor.alias("visitor_hash"), day_in(F.col("ts"), CLICK_ZONE).alias("day"))
    return rows.dropDuplicatesWithinWatermark(["work_id", "visitor_hash", "day"])


def activity_stream(heartbeats: DataFrame, late: str = "1 day") -> DataFrame:
    """Seconds a user and UTC day, a day at most; for update or complete mode."""
    day = F.window("ts", "1 day")
    rows = heartbeats.withWatermark("ts", late).groupBy("user_id", day.alias("w")).agg(F.sum("seconds").alias("s"))
    return rows.select("user_id", F.to_date("w.start").alias("activity_date"), F.least(F.lit(DAY_SECONDS).cast("long"), "s").alias("active_seconds"))


def session_stream(heartbeats: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions as they close, in append mode."""
    w = F.session_window("ts", gap)
    rows = heartbeats.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("beats"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return rows.drop("w")


def ingest_stream(files: DataFrame, apply_batch, checkpoint: str):
    """Runs ``apply_batch(rows, batch_id)`` over new files, each batch once; the batch id keys idempotent writes."""
    return files.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
