"""Windows over event time; the same plan serves a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table as a stream of files. ``ts`` becomes a timestamp, as watermarks need one."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger)
    return read.parquet(f"{sf_dir}/{{events}}.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): counts and sums of value by window; rows later than ``late`` are dropped in a stream."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n, total): rows of a user that follow each other within ``gap``; the end is that of the gap.

    The same plan for a table and a stream. On a stream the states of sessions
    that a row joins are merged, a session comes out when the watermark has
    passed its end, and rows later than ``late`` are dropped. Rows without a
    user or a time are left out.
    """
    known = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    found = known.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
