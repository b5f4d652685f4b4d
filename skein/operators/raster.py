"""Rasters as long tables ``(row, col, value)``, null for missing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.checks import ContractError
from skein.operators.components import connected_components
from skein.operators.ranks import quantiles


def deviation_threshold(pixels: DataFrame, value: str, k: float) -> DataFrame:
    """One row: mean less ``k`` population deviations of the valid values, as ``cut``."""
    return pixels.agg((F.avg(value) - k * F.stddev_pop(value)).alias("cut"))


def shape(pixels: DataFrame) -> tuple:
    return tuple(pixels.agg(F.max("row"), F.max("col"), F.count("*")).first())


def change_mask(pre: DataFrame, post: DataFrame, occurrence: DataFrame, k: float = 2.0, permanent_over: float = 50.0) -> DataFrame:
    """``(row, col, diff, mask)`` of three aligned rasters: a drop below mean less ``k`` deviations that is not permanent water.

    The threshold comes from all pixels that are valid before and after; pixels whose
    occurrence is missing count there and are not masked in. Rasters of other shapes raise.
    """
    if len({shape(r) for r in (pre, post, occurrence)}) > 1:
        raise ContractError("rasters differ in shape")
    cells = pre.select("row", "col", F.col("value").alias("a")).join(post.select("row", "col", F.col("value").alias("b")), ["row", "col"])
    cells = cells.join(occurrence.select("row", "col", F.col("value").alias("o")), ["row", "col"]).withColumn("diff", F.col("b") - F.col("a"))
    cells = cells.join(F.broadcast(deviation_threshold(cells, "diff", k)), F.lit(True))
    mask = (F.col("diff") < F.col("cut")) & ~(F.col("o") > permanent_over)
    return cells.select("row", "col", "diff", F.coalesce(mask, F.lit(False)).alias("mask"))


def mask_regions(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """``(row, col, region)`` of the masked pixels; pixels that touch share a region, named by its first pixel's id."""
    on = mask.where("mask").select("row", "col", (F.col("row").cast("long") * (1 << 32) + F.col("col")).alias("id"))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))
    asked = on.select("id", (F.col("row")).alias("r0"), F.col("col").alias("c0"), offsets.alias("s"))
    asked = asked.select("id", (F.col("r0") + F.col("s.r")).alias("row"), (F.col("c0") + F.col("s.c")).alias("col"))
    touching = asked.join(on.withColumnRenamed("id", "other"), ["row", "col"]).select("id", "other")
    parts = connected_components(touching, "id", "other")
    return on.join(parts, on["id"] == parts["node"], "left").select("row", "col", F.coalesce("component", "id").alias("region"))


def sieve(mask: DataFrame, least: int = 8, diagonal: bool = True) -> DataFrame:
    """Masked pixels in regions of at least ``least`` pixels."""
    regions = mask_regions(mask, diagonal)
    large = regions.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return regions.join(large, "region", "left_semi")


def slope(pixels: DataFrame, dx: float, dy: float) -> DataFrame:
    """Slope in degrees by central differences, one-sided at the edges; null where a neighbour is missing."""

    def gradient(partition: str, order: str, step: float) -> Column:
        w = Window.partitionBy(partition).orderBy(order)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        first, last = F.lag("row").over(w).isNull(), F.lead("row").over(w).isNull()
        return (
            F.when(first & last, F.lit(0.0))
            .when(first, (after - F.col("value")) / step)
            .when(last, (F.col("value") - before) / step)
            .otherwise((after - before) / (2 * step))
        )

    g = pixels.withColumns({"gx": gradient("row", "col", dx), "gy": gradient("col", "row", dy)})
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope_deg"))


def focal_median(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Median of the valid values of the square around each pixel."""
    ring = F.sequence(F.lit(-radius), F.lit(radius))
    sent = pixels.where("value IS NOT NULL").withColumn("dr", F.explode(ring)).withColumn("dc", F.explode(ring))
    sent = sent.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "value")
    medians = sent.groupBy("row", "col").agg(F.median("value").alias("median"))
    return pixels.select("row", "col").join(medians, ["row", "col"], "left")


def over_threshold(pixels: DataFrame, least: float) -> DataFrame:
    """A mask of values over ``least``; missing data is never in it."""
    return pixels.select("row", "col", F.coalesce(F.col("value") > least, F.lit(False)).alias("mask"))


def overlap(a: DataFrame, b: DataFrame, cell_area: float) -> DataFrame:
    """Areas of two masks and of their intersection, and the share of the first that the second covers in per cent."""
    both = a.select("row", "col", F.col("mask").alias("a")).join(b.select("row", "col", F.col("mask").alias("b")), ["row", "col"], "full")
    n_a, n_ab = F.count_if(F.col("a")), F.count_if(F.col("a") & F.col("b"))
    return both.agg(
        F.round(n_a * cell_area, 6).alias("area_first"),
        F.round(F.count_if(F.col("b")) * cell_area, 6).alias("area_second"),
        F.round(n_ab * cell_area, 6).alias("area_both"),
        F.round(F.try_divide(n_ab * 100.0, n_a.cast("double")), 4).alias("pct_of_first"),
    )


def region_areas(regions: DataFrame, cell_area: float) -> DataFrame:
    """Number, total, largest and median area of regions."""
    areas = regions.groupBy("region").agg((F.count("*") * cell_area).alias("area"))
    middle = quantiles(areas.withColumn("all", F.lit(0)), "all", "area", [0.5]).select(F.round("value", 6).alias("median"))
    plain = areas.agg(F.count("*").alias("n_regions"), F.round(F.sum("area"), 6).alias("total"), F.round(F.max("area"), 6).alias("largest"))
    return plain.join(F.broadcast(middle), F.lit(True), "left")


def region_edges(regions: DataFrame) -> DataFrame:
    """``(region, x0, y0, x1, y1)``: the sides of pixels that bound each region, clockwise around it in columns and rows."""
    steps = [(-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0))]
    sides = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((r, c, *e), ("r", "c", "a", "b", "p", "q"), strict=True)]) for r, c, e in steps]))
    asked = regions.select("row", "col", "region", sides.alias("s"))
    asked = asked.select("region", "s", F.col("row").alias("y"), F.col("col").alias("x"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    outer = asked.join(regions.select("row", "col", "region"), ["row", "col", "region"], "left_anti")
    return outer.select("region", (F.col("x") + F.col("s.a")).alias("x0"), (F.col("y") + F.col("s.b")).alias("y0"), (F.col("x") + F.col("s.p")).alias("x1"), (F.col("y") + F.col("s.q")).alias("y1"))


def _rings(edges):
    import pandas as pd

    after: dict[tuple, list] = {}
    for x0, y0, x1, y1 in edges[["x0", "y0", "x1", "y1"]].sort_values(["y0", "x0", "y1", "x1"]).itertuples(index=False):
        after.setdefault((x0, y0), []).append((x1, y1))
    out = []
    for start in list(after):
        while after.get(start):
            ring, at = [], start
            while after.get(at):
                # where two pixels touch at a corner, turn so that the ring does not cross itself
                if len(after[at]) > 1 and ring:
                    dx, dy = at[0] - ring[-1][0], at[1] - ring[-1][1]
                    after[at].sort(key=lambda to: dx * (to[1] - at[1]) - dy * (to[0] - at[0]))  # noqa: B023
                ring.append(at)
                at = after[at].pop()
            straight = [(ring[k - 1][0] - p[0]) * (ring[(k + 1) % len(ring)][1] - p[1]) == (ring[k - 1][1] - p[1]) * (ring[(k + 1) % len(ring)][0] - p[0]) for k, p in enumerate(ring)]
            out.append([{"x": float(x), "y": float(y)} for (x, y), s in zip(ring, straight, strict=True) if not s])
    return pd.DataFrame({"region": [edges["region"].iloc[0]] * len(out), "ring": out})


def region_outlines(regions: DataFrame) -> DataFrame:
    """``(region, ring)``: the outlines of each region ``(row, col, region)`` in columns and rows, holes as rings of their own.

    Only the sides that bound a region travel, not its pixels; a region's sides meet in one task.
    """
    return region_edges(regions).groupBy("region").applyInPandas(_rings, "region long, ring array<struct<x:double,y:double>>")


def sampled_means(pixels: DataFrame, control: DataFrame, target: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Mean value of a seeded sample of control and of target pixels; the sample is drawn by a hash of the place, so it repeats."""

    def drawn(mask, name):
        chosen = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
        return mask.where("mask").where(chosen).select("row", "col", F.lit(name).alias("group"))

    rows = drawn(control, "control").unionByName(drawn(target, "target")).join(pixels, ["row", "col"])
    return rows.groupBy("group").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
