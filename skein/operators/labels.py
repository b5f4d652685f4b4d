"""Labels fused from several sources of evidence, per entity and phase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import percent
from skein.operators.ranks import numbered, quantiles


def fuse(spine: DataFrame, sources: dict[str, DataFrame], phases: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """One row per entity and phase with a flag per source, how many agree, and the label.

    An entity is labelled in a flooded phase if any source names it, unless the phase is the
    ``receding`` one and it is in ``recovered``; that mark is set whether or not a source names
    the entity. ``phases (phase_id, phase_name, flooded, receding)`` is a handful of rows.
    """
    rows = spine.select(key).distinct()
    for name, ids in sources.items():
        marked = ids.select(key).distinct().withColumn(f"in_{name}", F.lit(1))
        rows = rows.join(marked, key, "left").fillna(0, [f"in_{name}"])
    rows = rows.join(recovered.select(key).distinct().withColumn("recovered_set", F.lit(True)), key, "left")
    flags = [f"in_{name}" for name in sources]
    rows = rows.withColumn("n_sources", reduce(lambda a, b: a + b, [F.col(f) for f in flags]))
    back = F.col("receding") & F.coalesce("recovered_set", F.lit(False))
    label = F.col("flooded") & (F.col("n_sources") > 0) & ~back
    return rows.crossJoin(F.broadcast(phases)).select(
        key, "phase_id", *flags, "n_sources", back.cast("int").alias("recovered"), label.cast("int").alias("flood_label")
    )


def spread(spine: DataFrame, phases: DataFrame) -> DataFrame:
    """Every entity with every phase's features; phases are a handful of rows."""
    return spine.crossJoin(F.broadcast(phases))


def label_rates(labels: DataFrame) -> DataFrame:
    flooded = F.count_if(F.col("flood_label") == 1)
    return labels.groupBy("phase_id").agg(
        flooded.alias("n_flooded"), F.count("*").alias("n"), percent(flooded, F.count("*")).alias("pct")
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def uniform_within(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """Whether each column has one value per group."""
    return df.groupBy(group).agg(*[(F.count_distinct(c) == 1).alias(f"{c}_uniform") for c in columns])


def union_of(sets: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [s.select(key) for s in sets]).distinct()


def recovered(before: DataFrame, still: DataFrame, key: str) -> DataFrame:
    """Ids flooded before and no longer."""
    return before.select(key).subtract(still.select(key))


def recession(before: DataFrame, still: DataFrame, key: str) -> DataFrame:
    """Counts of a recession: how many before, of them still, recovered, and the share recovered (0.0 of none)."""
    marked = before.select(key).distinct().withColumn("b", F.lit(1))
    left = still.select(key).distinct().withColumn("s", F.lit(1))
    both = marked.join(left, key, "left")
    n, still_n = F.count("*"), F.count("s")
    return both.agg(
        n.alias("n_before"),
        still_n.alias("n_still"),
        (n - still_n).alias("n_recovered"),
        F.round(F.coalesce(F.try_divide((n - still_n).cast("double"), n.cast("double")), F.lit(0.0)) * 100, 2).alias("pct_recovered"),
    )


def transitions(labels: DataFrame, phases: DataFrame, key: str) -> DataFrame:
    """Labels at ``t`` and at the phase after it, for each pair of consecutive phases; the last phase has none."""
    after = phases.select("phase_id", F.lead("phase_id").over(Window.orderBy("phase_id")).alias("next_phase"))
    pairs = after.where("next_phase IS NOT NULL")
    now = labels.select(key, "phase_id", F.col("flood_label").alias("y_t"))
    then = labels.select(key, F.col("phase_id").alias("next_phase"), F.col("flood_label").alias("y_next"))
    return now.join(F.broadcast(pairs), "phase_id").join(then, [key, "next_phase"]).select(key, "phase_id", "next_phase", "y_t", "y_next")


def tag_counts(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows by value, and whether the value is allowed."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("allowed", F.col(column).isin(allowed))


def staggered_reveal(changes: DataFrame, steps: int = 40) -> DataFrame:
    """The step at which each changed entity is shown: newly on ones from low to high, then newly off ones from high to low.

    ``changes (key, y_t, y_next, elevation)``; a missing elevation counts as the median. Each
    step shows ``max(1, ceil(n / steps))`` entities.
    """
    middle = quantiles(changes.withColumn("__all", F.lit(0)), "__all", "elevation", [0.5]).select(F.col("value").alias("__middle"))
    moved = changes.where("y_t <> y_next").withColumn("on", F.col("y_next") == 1).join(F.broadcast(middle), F.lit(True), "left")
    height = F.coalesce("elevation", "__middle")
    shown = moved.select("key", "on", F.when(F.col("on"), 0).otherwise(1).alias("first"), F.when(F.col("on"), height).otherwise(-height).alias("up"))
    ordered = numbered(shown, "first", "up", "key", name="k")
    chunk = F.broadcast(ordered.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / steps)).alias("chunk")))
    return ordered.join(chunk, F.lit(True)).select("key", "on", F.floor(F.col("k") / F.col("chunk")).cast("long").alias("step"))


def joined_reports(names: list[str], splits: list[str], **reports: DataFrame) -> DataFrame:
    """One row per name and split with each report's value, null where a report lacks it. Reports are ``(name, split, value)``."""
    first = next(iter(reports.values()))
    spark = first.sparkSession
    rows = spark.createDataFrame([(n, s) for n in names for s in splits], "name string, split string")
    for column, report in reports.items():
        rows = rows.join(report.select("name", "split", F.col("value").alias(column)), ["name", "split"], "left")
    return rows
