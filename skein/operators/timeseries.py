"""Temporal downscaling and totals over named time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly(events: DataFrame, time: str, value: str) -> DataFrame:
    """``(time, value)``: sums by the hour."""
    hour = F.date_trunc("hour", time).cast("timestamp_ntz")
    return events.groupBy(hour.alias("time")).agg(F.sum(value).alias("value"))


def downscale(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Spread daily totals ``coarse (date, total)`` over the hours of ``fine (time, value)`` by their share of the day.

    An hour of a day whose hours sum to zero gets 1/24 of the day's total, however many hours
    there are; a day without a total counts as zero. One row per row of ``fine``:
    ``(time, date, share, amount)``.
    """
    rows = fine.withColumn("date", F.to_date("time"))
    # days are few beside rows: their sums come from a partial aggregate, and the join can be broadcast or split
    days = rows.groupBy("date").agg(F.sum("value").alias("day_sum")).join(coarse, "date", "left")
    share = F.when(F.col("day_sum") != 0, F.col("value") / F.col("day_sum")).otherwise(F.lit(1.0) / 24)
    return rows.join(days, "date").select(
        "time", "date", share.alias("share"), (share * F.coalesce("total", F.lit(0.0))).alias("amount")
    )


def missing_totals(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Days of ``fine`` for which there is no daily total, with the number of their rows."""
    rows = fine.groupBy(F.to_date("time").alias("date")).agg(F.count("*").alias("n_rows"))
    return rows.join(coarse, "date", "left_anti")


def phase_totals(series: DataFrame, phases: DataFrame, time: str = "time", amount: str = "amount") -> DataFrame:
    """Sum and row count in each phase ``(phase_id, phase_name, start, end)``, ends included.

    Phases are a handful of rows, so the interval join broadcasts them and rows are summed up
    before any shuffle. A phase without rows has 0.0 and 0.
    """
    day = F.to_date(time)
    inside = series.join(F.broadcast(phases), (day >= F.col("start")) & (day <= F.col("end")))
    sums = inside.groupBy("phase_id").agg(F.sum(amount).alias("s"), F.count("*").alias("n"))
    return phases.join(sums, "phase_id", "left").select(
        "phase_id",
        "phase_name",
        F.round(F.coalesce("s", F.lit(0.0)), 3).alias("rainfall_t"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_hours"),
    )


def running_total(totals: DataFrame, value: str = "rainfall_t", out: str = "cumulative_rainfall_t") -> DataFrame:
    """Running sum of the rounded totals in phase order, rounded again. One row per phase, so one partition is enough."""
    order = Window.orderBy("phase_id").rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn(out, F.round(F.sum(value).over(order), 3))


def intensity(totals: DataFrame) -> DataFrame:
    """Amount per day of each phase."""
    per_day = F.try_divide(F.col("rainfall_t"), F.col("n_hours").cast("double")) * 24
    return totals.withColumn("intensity", F.round(per_day, 3))


def daily(events: DataFrame, time: str, value: str) -> DataFrame:
    return events.groupBy(F.to_date(time).alias("date")).agg(F.round(F.sum(value), 3).alias("total"))


def wettest(days: DataFrame, k: int) -> DataFrame:
    """The ``k`` days of the largest totals, earlier days first among equals."""
    return days.orderBy(F.desc("total"), "date").limit(k)


def peak(series: DataFrame) -> DataFrame:
    """The row of the largest value, the earliest among equals."""
    return series.orderBy(F.desc("value"), "time").limit(1)
