"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import drop_materialized, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its smallest node.

    Every round points each node at the smallest node it can see, first among its larger
    neighbours and then among its smaller ones, so the depth shrinks geometrically and no
    adjacency list is gathered: each step is a partial aggregate and an equi join, which AQE
    can split when one hub holds most edges. Each round is written to the shared folder, so
    the lineage stays short. Edges with a null end are ignored; self loops yield their node
    alone; an empty input yields an empty table.
    """
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("hi"), F.col(dst).alias("lo"))
    now = (
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .unionByName(loops)
        .distinct()
    )
    now = materialize(now, "edges", compact=True)
    n = now.count()
    seen = None
    for _ in range(max_rounds):
        # no round has more edges than the one before, beside the loops
        step = materialize(_small_star(_large_star(now)), "edges", rows=n)
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        n = mark[0]
        drop_materialized(now)
        now = step
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: each node has one edge to its smallest node, beside a loop that it may have had; roots are targets or loops
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return members.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(e.where("hi = lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("hi > lo")
    least = down.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = down.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    kept = least.select("hi", F.col("m").alias("lo"))
    return kept.unionByName(moved).unionByName(e.where("hi = lo")).distinct()
