"""Hourly sums, phase totals and latest labels of an event stream.

The batch transforms hold no actions, so they also run on a stream; what a stream adds is a
watermark, which bounds the state, and sinks that take one micro-batch at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.text import upsert


def hourly_stream(events: DataFrame, time: str, value: str, late: str = "2 hours") -> DataFrame:
    """``(time, value)`` by the hour; rows later than ``late`` are dropped and closed hours leave the state."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    hours = stamped.groupBy(F.window("__t", "1 hour")).agg(F.sum(value).alias("value"), F.count("*").alias("n"))
    return hours.select(F.col("window.start").alias("time"), "value", "n")


def sliding_stream(events: DataFrame, time: str, value: str, length: str, step: str, late: str = "2 hours") -> DataFrame:
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    spans = stamped.groupBy(F.window("__t", length, step)).agg(F.sum(value).alias("value"))
    return spans.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value")


def phase_stream(events: DataFrame, phases: DataFrame, time: str, value: str) -> DataFrame:
    """Running total of each phase; the state is one row per phase."""
    day = F.to_date(time)
    inside = events.join(F.broadcast(phases), (day >= F.col("start")) & (day <= F.col("end")))
    return inside.groupBy("phase_id").agg(F.round(F.sum(value), 3).alias("rainfall_t"), F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no pause over ``gap``."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    spans = stamped.groupBy(user, F.session_window("__t", gap)).agg(F.count("*").alias("n"))
    return spans.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_into(path: str, key: str, order: str):
    """A ``foreachBatch`` function that merges each micro-batch into versioned Parquet under ``path``.

    Version ``k`` is written from version ``k - 1`` and the batch, so a batch that is replayed
    after a failure writes the same rows again.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch:
            stored = spark.read.parquet(f"{path}/v{epoch - 1}")
        else:
            stored = spark.createDataFrame([], batch.schema)
        upsert(stored, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return run
