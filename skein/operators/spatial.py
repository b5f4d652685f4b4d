"""Points, lines and simple polygons as arrays of ``struct<x, y>``: lengths, containment, nearest neighbours, sampling."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from skein.runtime import drop_materialized, materialize

POINTS = "array<struct<x:double,y:double>>"


def utm(lon: Column, lat: Column, zone: int | Column, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres on WGS84 by the Krüger series to the third order, as column expressions."""
    a, f = 6378137.0, 1 / 298.257223563  # semi-major axis and flattening of WGS84
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    scale = 0.9996 * radius
    return scale * x + 500000.0, scale * y + (10000000.0 if south else 0.0)


def zone_of(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def metric_lengths(lines: DataFrame, line_id: str, digits: int = 3) -> DataFrame:
    """``(line_id, length_m)`` of lines in degrees, measured in the UTM zone at the middle of all of them, rounded once to ``digits``.

    The middle is one row that joins every line. An empty table gives no rows, a missing line null.
    """
    xs, ys = F.transform("geom", lambda p: p["x"]), F.transform("geom", lambda p: p["y"])
    ends = {"x0": F.min(F.array_min(xs)), "x1": F.max(F.array_max(xs)), "y0": F.min(F.array_min(ys)), "y1": F.max(F.array_max(ys))}
    middle = lines.agg(*[c.alias(f"__{n}") for n, c in ends.items()])
    middle = middle.select(zone_of((F.col("__x0") + F.col("__x1")) / 2).alias("__zone"), (F.col("__y0") + F.col("__y1") < 0).alias("__south"))

    def metres(p):
        x, y = utm(p["x"], p["y"], F.col("__zone"))
        return F.struct(x.alias("x"), (y + F.when(F.col("__south"), 10000000.0).otherwise(0.0)).alias("y"))

    flat = lines.join(F.broadcast(middle), F.lit(True)).select(line_id, F.transform("geom", metres).alias("geom"))
    return flat.select(line_id, F.when(F.col("geom").isNotNull(), F.round(line_length(F.col("geom")), digits)).alias("length_m"))


def coalesced_geometry(geom: Column, start: Column, end: Column) -> Column:
    """The line itself, else the straight line between its ends."""
    return F.coalesce(geom, F.array(start, end))


def line_length(points: Column) -> Column:
    """Sum of the distances between consecutive points; 0.0 for fewer than two."""
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda i: F.when(
            i < F.size(points),
            F.hypot(F.element_at(points, i + 1)["x"] - F.element_at(points, i)["x"], F.element_at(points, i + 1)["y"] - F.element_at(points, i)["y"]),
        ).otherwise(0.0),
    )
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0)))).otherwise(0.0)


def spaced_points(lines: DataFrame, line_id: str, step: float = 15.0, most: int = 50) -> DataFrame:
    """``(line_id, k, x, y)``: points at even spacing along each line ``geom``, whatever its bends, both ends included.

    There are ``max(2, min(most, floor(length / step) + 2))`` of them; a line of one place gives it twice.
    """
    g = F.col("geom")
    gap = lambda i: F.hypot(F.element_at(g, i)["x"] - F.element_at(g, i - 1)["x"], F.element_at(g, i)["y"] - F.element_at(g, i - 1)["y"])
    # how far along the line each of its points is
    far = F.aggregate(F.sequence(F.lit(2), F.size(g)), F.array(F.lit(0.0)), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + gap(i))))
    far = F.when(F.size(g) > 1, far).otherwise(F.array(F.lit(0.0)))
    rows = lines.where("size(geom) > 0").select(line_id, "geom", far.alias("far")).withColumn("total", F.element_at("far", -1))
    n = F.greatest(F.lit(2), F.least(F.lit(most), (F.floor(F.col("total") / step) + 2).cast("int")))
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("at", F.col("total") * F.col("k") / (F.col("n") - 1))
    before = F.greatest(F.lit(1), F.least(F.size("geom") - 1, F.size(F.expr("filter(far, f -> f <= at)"))))
    rows = rows.withColumn("i", before).withColumn("j", F.least(F.col("i") + 1, F.size("geom")))
    part = F.coalesce(F.try_divide(F.col("at") - F.expr("far[i - 1]"), F.expr("far[j - 1] - far[i - 1]")), F.lit(0.0))
    rows = rows.withColumns({"part": part, "a": F.expr("geom[i - 1]"), "b": F.expr("geom[j - 1]")})
    place = [(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("part")).alias(c) for c in ("x", "y")]
    return rows.select(line_id, "k", *place)


def segments_of(lines: DataFrame, line_id: str) -> DataFrame:
    """``(line_id, ax, ay, bx, by)``: the straight parts of each line ``geom``; a line of one place is one part without length."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("geom") - 1, F.lit(1))),
        lambda i: F.struct(F.element_at("geom", i).alias("a"), F.element_at("geom", F.least(i + 1, F.size("geom"))).alias("b")),
    )
    parts = lines.where("size(geom) > 0").select(line_id, F.explode(pairs).alias("__part"))
    return parts.select(line_id, *[F.col(f"__part.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])


def _turn(ax, ay, bx, by, px, py) -> Column:
    """Positive if ``p`` is to the left of the way from ``a`` to ``b``, zero on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two straight parts have a place in common; touching counts."""
    apart = (
        (F.greatest(ax, bx) < F.least(cx, dx)) | (F.greatest(cx, dx) < F.least(ax, bx))
        | (F.greatest(ay, by) < F.least(cy, dy)) | (F.greatest(cy, dy) < F.least(ay, by))
    )
    one = F.signum(_turn(ax, ay, bx, by, cx, cy)) * F.signum(_turn(ax, ay, bx, by, dx, dy)) <= 0
    two = F.signum(_turn(cx, cy, dx, dy, ax, ay)) * F.signum(_turn(cx, cy, dx, dy, bx, by)) <= 0
    return ~apart & one & two


def _to_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance of a place to a straight part."""
    along = F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance of two straight parts, zero where they meet."""
    apart = F.least(_to_segment(ax, ay, cx, cy, dx, dy), _to_segment(bx, by, cx, cy, dx, dy), _to_segment(cx, cy, ax, ay, bx, by), _to_segment(dx, dy, ax, ay, bx, by))
    return F.when(segments_meet(ax, ay, bx, by, cx, cy, dx, dy), F.lit(0.0)).otherwise(apart)


def _cells_of(df: DataFrame, cell: float, x0, x1, y0, y1, more: int = 0) -> DataFrame:
    """A row for each grid cell of the rows' bounds, ``more`` cells wider."""
    df = df.withColumn("cx", F.explode(F.sequence(_cell(F.least(x0, x1), cell) - more, _cell(F.greatest(x0, x1), cell) + more)))
    return df.withColumn("cy", F.explode(F.sequence(_cell(F.least(y0, y1), cell) - more, _cell(F.greatest(y0, y1), cell) + more)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a simple ring, by the parity of the edges that a ray to the right crosses."""
    n = F.size(ring)
    crossings = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: _crosses(F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1)), x, y),
    )
    return F.aggregate(crossings, F.lit(0), lambda s, c: s + c) % 2 == 1


def _crosses(a, b, x: Column, y: Column) -> Column:
    straddles = (a["y"] > y) != (b["y"] > y)
    # straddling ends differ in y, so the division is safe where it counts
    at = a["x"] + F.coalesce(F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]), F.lit(0.0))
    return (straddles & (x < at)).cast("int")


def ring_area(ring: Column) -> Column:
    """Area of a simple ring."""
    n = F.size(ring)
    terms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: _shoelace(F.element_at(ring, i), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1))),
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, c: s + c)) / 2


def _shoelace(a, b) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _ring_cells(polygons: DataFrame, ring: str, size: float) -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    cells = polygons.withColumn("cx", F.explode(F.sequence(_cell(F.array_min(xs), size), _cell(F.array_max(xs), size))))
    return cells.withColumn("cy", F.explode(F.sequence(_cell(F.array_min(ys), size), _cell(F.array_max(ys), size))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell: float) -> DataFrame:
    """``points`` with the polygon each is in, null for none, the smallest id for several.

    Polygons are dealt to the grid cells of their bounds and meet points by cell; the exact
    test runs only there.
    """
    dealt = _ring_cells(polygons.select(polygon_id, "ring"), "ring", cell)
    keyed = points.withColumns({"cx": _cell(F.col("x"), cell), "cy": _cell(F.col("y"), cell)})
    hits = keyed.join(dealt, ["cx", "cy"]).where(contains(F.col("ring"), F.col("x"), F.col("y")))
    first = hits.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))
    return points.join(first, point_id, "left")


def lines_meeting_boxes(lines: DataFrame, boxes: DataFrame, line_id: str, cell: float) -> DataFrame:
    """Ids of lines, of any number of bends, that meet at least one box ``(x0, y0, x1, y1)``; no boxes, no ids."""
    ends = [F.col(c) for c in ("ax", "bx", "ay", "by")]
    near = _cells_of(segments_of(lines, line_id), cell, *ends).join(
        _cells_of(boxes.select("x0", "y0", "x1", "y1"), cell, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")), ["cx", "cy"]
    )
    # the part of the line inside the box's slab in x, and in y, must overlap
    def span(p, q, low, high):
        d = q - p
        t0, t1 = F.try_divide(low - p, d), F.try_divide(high - p, d)
        flat = (p >= low) & (p <= high)
        enter = F.when(d != 0, F.least(t0, t1)).when(flat, F.lit(0.0)).otherwise(F.lit(2.0))
        leave = F.when(d != 0, F.greatest(t0, t1)).when(flat, F.lit(1.0)).otherwise(F.lit(-1.0))
        return enter, leave

    ex, lx = span(F.col("ax"), F.col("bx"), F.col("x0"), F.col("x1"))
    ey, ly = span(F.col("ay"), F.col("by"), F.col("y0"), F.col("y1"))
    meets = F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))
    return near.where(meets).select(line_id).distinct()


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, line_id: str, cell: float) -> DataFrame:
    """Ids of lines that meet at least one simple polygon ``ring``: a part begins inside or crosses an edge. No polygons, no ids."""
    a, b, c, d = (F.col(x) for x in ("ax", "bx", "ay", "by"))
    near = _cells_of(segments_of(lines, line_id), cell, a, b, c, d).join(_ring_cells(polygons.select("ring"), "ring", cell), ["cx", "cy"])
    n = F.size("ring")

    def crosses(i):
        p, q = F.element_at("ring", i), F.element_at("ring", F.when(i == n, F.lit(1)).otherwise(i + 1))
        return segments_meet(a, c, b, d, p["x"], p["y"], q["x"], q["y"])

    meets = contains(F.col("ring"), a, c) | F.exists(F.sequence(F.lit(1), n), crosses)
    return near.where(meets).select(line_id).distinct()


#: Parts of sites in a cell that lines meet at first, and rows of them that are broadcast.
FEW_PARTS, BROADCAST_ROWS = 32, 100_000


def _shares_of_sites(theirs: DataFrame, site_id: str, per_cell: float) -> list[Column]:
    """Conditions that deal sites by ascending id, first so many that a cell holds ``FEW_PARTS`` of their parts, then four times as many, and so on."""
    shares = []
    while (share := FEW_PARTS / max(per_cell, FEW_PARTS) * 4 ** len(shares)) < 1:
        shares.append(share)
    if not shares or not isinstance(theirs.schema[site_id].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return [F.lit(True)]
    ends = sorted({int(x) for x in theirs.approxQuantile(site_id, shares, 0.005)})
    key = F.col(site_id)
    low = [F.lit(True), *[key > x for x in ends]]
    return [a & b for a, b in zip(low, [*[key <= x for x in ends], F.lit(True)], strict=True)]


PARTS = ["ax", "ay", "bx", "by", "sax", "say", "sbx", "sby"]


def _distances(ax, ay, bx, by, cx, cy, dx, dy):
    """``segment_distance`` of arrays."""
    import numpy as np

    def turn(ax, ay, bx, by, px, py):
        return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def far(px, py, ax, ay, bx, by):
        ux, uy = bx - ax, by - ay
        square = ux * ux + uy * uy
        t = np.clip(np.divide((px - ax) * ux + (py - ay) * uy, square, out=np.zeros_like(px), where=square != 0), 0.0, 1.0)
        return np.hypot(px - ax - t * ux, py - ay - t * uy)

    apart = (np.maximum(ax, bx) < np.minimum(cx, dx)) | (np.maximum(cx, dx) < np.minimum(ax, bx))
    apart |= (np.maximum(ay, by) < np.minimum(cy, dy)) | (np.maximum(cy, dy) < np.minimum(ay, by))
    meet = ~apart & (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0)
    out = np.minimum(np.minimum(far(ax, ay, cx, cy, dx, dy), far(bx, by, cx, cy, dx, dy)), np.minimum(far(cx, cy, ax, ay, bx, by), far(dx, dy, ax, ay, bx, by)))
    return np.where(meet, 0.0, out)


def _best_pairs(line_id: str, site_id: str, most: float, batches):
    for pairs in batches:
        pairs["distance"] = _distances(*[pairs[c].to_numpy("float64") for c in PARTS])
        near = pairs.loc[pairs["distance"] <= most, [line_id, site_id, "distance"]]
        yield near.sort_values([line_id, "distance", site_id]).drop_duplicates(line_id)


def _sites_within(asked: DataFrame, there: DataFrame, line_id: str, site_id: str, most: float) -> DataFrame:
    """``(line_id, site_id, distance)``: of the parts that share a cell the nearest site within ``most``.

    Bounds choose pairs in the join; distances are taken in arrays, since as one expression they
    make a method too long to be compiled. Each batch keeps the best of a line, so pairs are
    neither sorted nor written.
    """
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c) for c in PARTS)
    near = (F.greatest(ax, bx) + most >= F.least(cx, dx)) & (F.greatest(cx, dx) + most >= F.least(ax, bx))
    near &= (F.greatest(ay, by) + most >= F.least(cy, dy)) & (F.greatest(cy, dy) + most >= F.least(ay, by))
    pairs = asked.join(there, ["cx", "cy"]).where(near).select(line_id, site_id, *PARTS)
    kinds = f"`{line_id}` {asked.schema[line_id].dataType.simpleString()}, `{site_id}` {there.schema[site_id].dataType.simpleString()}, distance double"
    best = pairs.mapInPandas(partial(_best_pairs, line_id, site_id, most), kinds).groupBy(line_id).agg(F.min(F.struct("distance", site_id)).alias("b"))
    return materialize(best.select(line_id, f"b.{site_id}", "b.distance"), "nearest")


def nearest_lines(lines: DataFrame, sites: DataFrame, line_id: str, site_id: str, cell: float, max_rounds: int = 60) -> DataFrame:
    """``(line_id, site_id, distance)``: the site line nearest to each line, the smallest id among equals; both are ``geom`` with any bends.

    Lines that meet a site are settled first, by shares of ascending sites: what meets shares a
    cell, and a line leaves with the first share that it meets, so where sites are dense most
    lines never see most of them. Then a round joins the parts of lines not yet settled to the
    parts of sites in their cells and the cells around; a line is settled once its best distance
    is within one cell, and the cells of the next round are twice as large. Without sites no row.
    """
    theirs = segments_of(sites, site_id).toDF(site_id, "sax", "say", "sbx", "sby")
    theirs = materialize(theirs, "site_parts")
    own = [F.col(c) for c in ("ax", "bx", "ay", "by")]
    left = materialize(segments_of(lines, line_id), "line_parts", compact=True)
    out = left.select(line_id).limit(0).join(theirs.select(site_id).limit(0), F.lit(True)).withColumn("distance", F.lit(None).cast("double"))
    if theirs.isEmpty():
        return out

    def sites_in_cells():
        return _cells_of(theirs, cell, F.col("sax"), F.col("sbx"), F.col("say"), F.col("sby"))

    def without(best):
        rest = materialize(left.join(best, line_id, "left_anti"), "line_parts", compact=True)
        drop_materialized(left)
        return rest

    n, cells = sites_in_cells().groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    shares = _shares_of_sites(theirs, site_id, (n or 0) / max(cells, 1))
    for k, share in enumerate(shares):
        there = sites_in_cells().where(share)
        if k == 0 and min(n or 0, FEW_PARTS * cells) <= BROADCAST_ROWS:
            there = F.broadcast(there)
        best = _sites_within(_cells_of(left, cell, *own), there, line_id, site_id, 0.0)
        out, left = out.unionByName(best), without(best)
        if left.isEmpty():
            return out
    for _ in range(max_rounds):
        best = _sites_within(_cells_of(left, cell, *own, more=1), sites_in_cells(), line_id, site_id, cell)
        out, left = out.unionByName(best), without(best)
        if left.isEmpty():
            return out
        cell *= 2
    raise RuntimeError("some lines found no site")


def nearest(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, cell: float, max_rounds: int = 40) -> DataFrame:
    """``(point_id, site_id, distance)``: the nearest site of each point, the smallest id among equals.

    Round ``r`` joins the points not yet settled to the sites at most ``r`` cells away; a
    point is settled once its best distance is within ``r`` cells, so no site further off can
    win. Rounds double their reach; every join is an equi join on cells. Without sites no row.
    """
    sites = sites.select(site_id, F.col("x").alias("sx"), F.col("y").alias("sy"), _cell(F.col("x"), cell).alias("cx"), _cell(F.col("y"), cell).alias("cy"))
    sites = materialize(sites, "sites")
    if sites.isEmpty():
        return points.select(point_id).limit(0).withColumns({site_id: F.lit(None).cast(sites.schema[site_id].dataType), "distance": F.lit(None).cast("double")})
    left = materialize(points.select(point_id, "x", "y"), "points")
    out, size, reach = None, cell, 1
    for _ in range(max_rounds):
        ring = F.sequence(F.lit(-reach), F.lit(reach))
        asked = left.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        asked = asked.withColumns({"cx": _cell(F.col("x"), size) + F.col("dx"), "cy": _cell(F.col("y"), size) + F.col("dy")})
        far = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
        best = asked.join(sites, ["cx", "cy"]).groupBy(point_id).agg(F.min(F.struct(far.alias("distance"), F.col(site_id))).alias("b"))
        best = materialize(best.where(F.col("b.distance") <= reach * size), "nearest")
        done = best.select(point_id, f"b.{site_id}", "b.distance")
        out = done if out is None else out.unionByName(done)
        left = materialize(left.join(best, point_id, "left_anti"), "points")
        if left.isEmpty():
            return out
        size *= 2  # coarser cells: the same number of lookups reaches twice as far
        sites = sites.withColumns({"cx": _cell(F.col("sx"), size), "cy": _cell(F.col("sy"), size)})
    raise RuntimeError("some points found no site")


def with_fallback(assigned: DataFrame, sites: DataFrame, point_id: str, site_id: str, cell: float) -> DataFrame:
    """Rows without a site get the nearest one; ``tier`` says which rows did."""
    missing = assigned.where(F.col(site_id).isNull())
    found = nearest(missing, sites, point_id, site_id, cell).select(point_id, F.col(site_id).alias("near"))
    joined = assigned.join(found, point_id, "left")
    tier = F.when(F.col(site_id).isNotNull(), "contained").when(F.col("near").isNotNull(), "nearest").otherwise("unresolved")
    return joined.select(point_id, F.coalesce(site_id, "near").alias(site_id), tier.alias("tier"))


def tiered_resolution(mentions: DataFrame, named: DataFrame, wards: DataFrame, cell: float) -> DataFrame:
    """Mentions ``(mention_id, name, x, y)`` resolved by exact name, else by the ward they lie in, else not.

    ``named (entity_id, name)`` holds one row per name of an entity; names compare without
    case, and a name of several entities resolves to all of them.
    """
    names = named.select("entity_id", F.lower(F.trim("name")).alias("key")).distinct()
    keyed = mentions.withColumn("key", F.lower(F.trim("name")))
    exact = keyed.join(names, "key").select("mention_id", F.col("entity_id").cast("string").alias("target"), F.lit("name_match").alias("tier"))
    rest = keyed.join(names, "key", "left_anti")
    placed = points_in_polygons(rest.select("mention_id", "x", "y"), wards, "mention_id", "ward_no", cell)
    tier = F.when(F.col("ward_no").isNotNull(), "ward_fallback").otherwise("unresolved_no_ward")
    return exact.unionByName(placed.select("mention_id", F.col("ward_no").cast("string").alias("target"), tier.alias("tier")))


def sample_raster(points: DataFrame, pixels: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Points with the value of their pixel, null outside the raster or on missing data."""
    keyed = points.withColumns({"row": F.floor((F.lit(y0) - F.col("y")) / dy).cast("int"), "col": F.floor((F.col("x") - F.lit(x0)) / dx).cast("int")})
    return keyed.join(pixels, ["row", "col"], "left").drop("row", "col")


def clipped_boxes(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Boxes cut to an area of interest, those outside dropped."""
    cut = boxes.withColumns({"x0": F.greatest("x0", F.lit(x0)), "y0": F.greatest("y0", F.lit(y0)), "x1": F.least("x1", F.lit(x1)), "y1": F.least("y1", F.lit(y1))})
    return cut.where("x1 > x0 AND y1 > y0")


def clipped_polygons(polygons: DataFrame, area: list[tuple[float, float]]) -> DataFrame:
    """``polygons`` with the part of each ``ring`` inside a convex area of interest, given counterclockwise; those outside are dropped.

    One edge of the area cuts at a time. A ring that the area cuts in several pieces stays one, joined along its edge.
    """
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*p, *q), ("px", "py", "qx", "qy"), strict=True)]) for p, q in zip(area, area[1:] + area[:1], strict=True)])
    none = F.array().cast(POINTS)

    def cut(ring, e):
        side = lambda p: (e["qx"] - e["px"]) * (p["y"] - e["py"]) - (e["qy"] - e["py"]) * (p["x"] - e["px"])

        def kept(b, i):
            a = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
            t = F.coalesce(F.try_divide(side(a), side(a) - side(b)), F.lit(0.0))
            at = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
            inside, crossed = side(b) >= 0, (side(a) >= 0) != (side(b) >= 0)
            return F.when(inside & crossed, F.array(at, b)).when(inside, F.array(b)).when(crossed, F.array(at)).otherwise(none)

        return F.flatten(F.transform(ring, kept))

    inside = polygons.withColumn("ring", F.aggregate(edges, F.col("ring").cast(POINTS), cut))
    return inside.where("size(ring) > 2").where(ring_area(F.col("ring")) > 0)


def area_by_label(areas: DataFrame, *labels: str, area: str) -> DataFrame:
    """Areas summed by a composite label, positive ones, largest first."""
    sums = areas.groupBy(*labels).agg(F.round(F.sum(area), 4).alias("area"))
    return sums.where("area > 0").orderBy(F.desc("area"), *labels)


def nearest_valid_cell(cells: DataFrame, x: float, y: float) -> DataFrame:
    """Of grid cells with any valid (non-negative) value the one nearest to a place, the smallest ``(cx, cy)`` among equals."""
    eligible = cells.groupBy("cx", "cy").agg(F.bool_or(F.coalesce(F.col("value") >= 0, F.lit(False))).alias("valid")).where("valid")
    far = F.hypot(F.col("cx") - x, F.col("cy") - y)
    return eligible.agg(F.min(F.struct(far.alias("d"), "cx", "cy")).alias("b")).select("b.cx", "b.cy", F.round("b.d", 6).alias("distance"))


def interpolated(table: list[tuple[float, float]], x: Column) -> Column:
    """Linear interpolation in a fixed table of ``(x, y)``, flat beyond its ends."""
    table = sorted(table)
    out = F.when(x <= table[0][0], F.lit(table[0][1]))
    for (xa, ya), (xb, yb) in zip(table[:-1], table[1:], strict=True):
        out = out.when(x <= xb, ya + (x - xa) * (yb - ya) / (xb - xa))
    return out.otherwise(F.lit(table[-1][1]))


def fit_homography(pairs: list[tuple[float, float, float, float]]) -> list[float]:
    """The eight numbers of the planar projection that takes ``(x, y)`` to ``(u, v)``, by least squares on control points."""
    import numpy as np

    rows, right = [], []
    for x, y, u, v in pairs:
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0].tolist()


def homography_errors(h: list[float], pairs: DataFrame) -> DataFrame:
    """One row with the root mean square, largest and mean distance of projected control points ``(x, y)`` from their ``(u, v)``."""
    u, v = apply_homography(h, F.col("x"), F.col("y"))
    far = pairs.select(F.hypot(u - F.col("u"), v - F.col("v")).alias("e"))
    return far.agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.max("e"), 6).alias("max_error"), F.round(F.avg("e"), 6).alias("mean_error")
    )


def apply_homography(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + 1
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def valid_geometry(points: Column) -> Column:
    """``missing``, ``empty``, ``short`` or ``ok``."""
    return F.when(points.isNull(), "missing").when(F.size(points) == 0, "empty").when(F.size(points) < 2, "short").otherwise("ok")


def wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in a given total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
