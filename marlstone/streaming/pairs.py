"""Joins of two streams, and running a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources import shared_path


def followed(causes: DataFrame, effects: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Each cause with each effect of its user that comes at its time or up to ``within`` later; causes without one come with nulls.

    (cause_id, user_id, cause_at, effect_id, effect_at), of two streams of ts,
    event_id and user_id. Rows later than ``late`` are dropped. State of both
    sides is bounded by the range of times: an effect is kept until no cause
    before it can come any more, and a cause until no effect can; then, if it
    has had none, it comes out by itself. Rows without a user or a time are
    left out.
    """
    a = causes.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("event_id").alias("cause_id"), "user_id", F.col("ts").alias("cause_at")).withWatermark("cause_at", late)
    b = effects.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("event_id").alias("effect_id"), F.col("user_id").alias("of_user"), F.col("ts").alias("effect_at")).withWatermark("effect_at", late)
    near = F.expr(f"user_id = of_user AND effect_at >= cause_at AND effect_at <= cause_at + INTERVAL {within}")
    return a.join(b, near, "left_outer").drop("of_user")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over all that its source has, to files in the shared folder, and gives what it put out."""
    spark = stream.sparkSession
    out, state = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-state")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
