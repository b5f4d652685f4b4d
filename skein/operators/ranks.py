"""Positions in a total order and exact quantiles, without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import materialize


def numbered(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """``df`` with each row's place in the given order, from 0; ties in ``order`` fall in any order.

    Rows are range-partitioned and sorted; a part's places start after the rows before it, of
    which only one count per part comes to the driver.
    """
    ordered = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    starts, at = [], 0
    for part, n in sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect()):
        starts.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    placed = ordered.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__k") - 1).alias(name))


def quantiles(df: DataFrame, group: str, value: str, at: list[float]) -> DataFrame:
    """``(group, p, value)``: exact quantiles with linear interpolation of the values of each group that are not null.

    Values are ranked by range partitions and the ranks asked for are picked by a join, so no
    task holds a group's values. Groups without values give no rows.
    """
    rows = numbered(df.select(group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), group, "v")
    sizes = rows.groupBy(group).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    wanted = sizes.select(group, "first", "n", F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("p"))
    place = (F.col("n") - 1) * F.col("p")
    wanted = wanted.select(group, "p", "first", place.alias("place"))
    ends = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")
    asked = wanted.select(group, "p", "place", ends, "first").withColumn("pos", F.col("first") + F.col("rank"))
    picked = asked.join(rows.select("pos", "v"), "pos")
    weight = 1 - F.abs(F.col("place") - F.col("rank"))
    return picked.groupBy(group, "p").agg(F.sum(weight * F.col("v")).alias("value"))
