import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.checks import ContractError
from skein.operators import raster, spatial


def pixels(spark, array):
    rows = [(r, c, None if v is None or v != v else float(v)) for r, line in enumerate(array) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def cells(df, value="value"):
    return {(r["row"], r["col"]): r[value] for r in df.collect()}


def test_change_mask_and_sieve(spark):
    rng = np.random.default_rng(0)
    pre = rng.uniform(-0.2, 0.2, (20, 20))
    post = rng.uniform(-0.2, 0.2, (20, 20))
    post[3:7, 3:7] -= 8
    post[12, 12] -= 8  # alone
    post[15:18, 2:5] -= 8
    occurrence = np.zeros((20, 20))
    occurrence[15:18, 2:5] = 90  # permanent water
    pre[0, 0] = float("nan")
    mask = raster.change_mask(pixels(spark, pre), pixels(spark, post), pixels(spark, occurrence), k=2.0)
    on = {k for k, v in cells(mask, "mask").items() if v}
    assert on == {(r, c) for r in range(3, 7) for c in range(3, 7)} | {(12, 12)}
    assert {(r["row"], r["col"]) for r in raster.sieve(mask, 8).collect()} == on - {(12, 12)}
    areas = raster.region_areas(raster.mask_regions(mask), 2.0).first()
    assert (areas.n_regions, areas.total, areas.largest, areas.median) == (2, 34.0, 32.0, 17.0)
    with pytest.raises(ContractError):
        raster.change_mask(pixels(spark, pre), pixels(spark, post[:5]), pixels(spark, occurrence))


def test_regions_touch_at_corners_or_not(spark):
    grid = [[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 1]]
    mask = raster.over_threshold(pixels(spark, grid), 0.5)
    assert len(set(cells(raster.mask_regions(mask), "region").values())) == 2
    assert len(set(cells(raster.mask_regions(mask, diagonal=False), "region").values())) == 3
    anti = raster.over_threshold(pixels(spark, [[0, 1], [1, 0]]), 0.5)
    assert len(set(cells(raster.mask_regions(anti), "region").values())) == 1


def test_slope_of_a_plane(spark):
    plane = [[10.0 * c for c in range(6)] for _ in range(5)]
    got = cells(raster.slope(pixels(spark, plane), 10.0, 10.0), "slope_deg")
    assert all(abs(v - 45) < 1e-9 for v in got.values())
    rough = np.random.default_rng(1).uniform(0, 9, (6, 7))
    gy, gx = np.gradient(rough, 30.0, 30.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    got = cells(raster.slope(pixels(spark, rough), 30.0, 30.0), "slope_deg")
    assert all(abs(got[r, c] - want[r, c]) < 1e-9 for r, c in got)


def test_focal_median_and_threshold(spark):
    grid = pixels(spark, [[1, 2, 3], [4, None, 6], [7, 8, 100]])
    got = cells(raster.focal_median(grid), "median")
    assert got[1, 1] == 5.0 and got[0, 0] == 2.0
    assert cells(raster.over_threshold(grid, 2.0), "mask")[1, 1] is False
    a, b = raster.over_threshold(grid, 3.0), raster.over_threshold(grid, 6.0)
    r = raster.overlap(a, b, 0.5).first()
    assert (r.area_first, r.area_second, r.area_both, r.pct_of_first) == (2.5, 1.5, 1.5, 60.0)
    assert raster.overlap(b.withColumn("mask", F.lit(False)), a, 1.0).first().pct_of_first is None


def test_samples_repeat(spark):
    grid = pixels(spark, np.arange(900).reshape(30, 30))
    on = raster.over_threshold(grid, -1)
    one = raster.sampled_means(grid, on, on, 0.5, 1).orderBy("group").collect()
    assert one == raster.sampled_means(grid, on, on, 0.5, 1).orderBy("group").collect()
    assert 300 < one[0].n < 600


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]


def test_containment_and_area(spark):
    wards = spark.createDataFrame([(1, RING), (2, [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0)])], f"ward_no int, ring {spatial.POINTS}")
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 2.0, 3.0), (3, 3.9, 3.0), (4, 11.5, 11.0), (5, -1.0, 1.0)], "p int, x double, y double")
    for cell in (0.5, 3.0, 50.0):
        got = {r.p: r.ward_no for r in spatial.points_in_polygons(points, wards, "p", "ward_no", cell).collect()}
        assert got == {1: 1, 2: None, 3: 1, 4: 2, 5: None}
    assert [r[0] for r in wards.orderBy("ward_no").select(spatial.ring_area(F.col("ring"))).collect()] == [10.0, 2.0]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p, s = rng.uniform(0, 100, (150, 2)), rng.uniform(0, 100, (7, 2))
    s[3] = s[2]  # a tie goes to the smaller id
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "p int, x double, y double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "s int, x double, y double")
    for cell in (2.0, 60.0):
        got = {r.p: (r.s, r.distance) for r in spatial.nearest(points, sites, "p", "s", cell).collect()}
        for i, place in enumerate(p):
            far = np.hypot(*(s - place).T)
            assert got[i][0] == int(np.argmin(far)) and abs(got[i][1] - far.min()) < 1e-9
    assert spatial.nearest(points, sites.limit(0), "p", "s", 5.0).collect() == []


def test_fallback_only_for_the_unmatched(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 9.0, 9.0, None)], "p int, x double, y double, w int")
    sites = spark.createDataFrame([(5, 9.0, 8.0), (6, 0.0, 0.0)], "w int, x double, y double")
    got = {r.p: (r.w, r.tier) for r in spatial.with_fallback(rows, sites, "p", "w", 5.0).collect()}
    assert got == {1: (5, "contained"), 2: (5, "nearest")}


def test_tiers(spark):
    wards = spark.createDataFrame([(1, RING)], f"ward_no int, ring {spatial.POINTS}")
    named = spark.createDataFrame([("s1", " Main Road"), ("s2", "main road "), ("s3", "Side")], "entity_id string, name string")
    mentions = spark.createDataFrame([(1, "MAIN ROAD", 0.5, 1.0), (2, "unknown", 0.5, 1.0), (3, "far", 50.0, 50.0)], "mention_id int, name string, x double, y double")
    got = sorted(tuple(r) for r in spatial.tiered_resolution(mentions, named, wards, 2.0).collect())
    assert got == [(1, "s1", "name_match"), (1, "s2", "name_match"), (2, "1", "ward_fallback"), (3, None, "unresolved_no_ward")]


def test_lines_and_boxes(spark):
    lines = [(1, [(0.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 5.0), (0.0, 9.0)]), (3, [(6.0, 4.0), (6.0, 4.0)]), (4, [(0.0, 3.0), (3.0, 0.0)])]
    table = spark.createDataFrame(lines, f"k int, geom {spatial.POINTS}")
    boxes = spark.createDataFrame([(4.0, 3.0, 7.0, 6.0), (5.0, 5.0, 6.0, 6.0), (0.0, 8.5, 1.0, 10.0)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.k for r in spatial.lines_meeting_boxes(table, boxes, "k", 2.0).collect()) == [1, 2, 3]
    assert spatial.lines_meeting_boxes(table, boxes.limit(0), "k", 2.0).collect() == []


def test_lengths_points_and_sampling(spark):
    table = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)],), ([(1.0, 1.0)],), ([],)], f"g {spatial.POINTS}")
    assert [r[0] for r in table.select(spatial.line_length(F.col("g"))).collect()] == [11.0, 0.0, 0.0]
    lines = [(1, [(0.0, 0.0), (30.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0)]), (3, [(5.0, 5.0)]), (4, [(0.0, 0.0), (1e6, 0.0)]), (5, []), (6, None)]
    found: dict = {}
    line = spark.createDataFrame(lines, f"id int, geom {spatial.POINTS}")
    for r in spatial.spaced_points(line, "id").orderBy("id", "k").collect():
        found.setdefault(("id", r.id), []).append((r.x, r.y))
    assert found["id", 1] == [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (30.0, 0.0)]
    assert found["id", 2] == [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0)]  # on the line, not across it
    assert found["id", 3] == [(5.0, 5.0)] * 2 and len(found["id", 4]) == 50
    assert ("id", 5) not in found and ("id", 6) not in found
    grid = pixels(spark, [[1.0, 2.0], [3.0, None]])
    spots = spark.createDataFrame([(0.5, 1.5), (1.5, 1.5), (0.5, 0.5), (1.5, 0.5), (9.0, 9.0)], "x double, y double")
    got = {(r.x, r.y): r.value for r in spatial.sample_raster(spots, grid, 0.0, 2.0, 1.0, 1.0).collect()}
    assert got == {(0.5, 1.5): 1.0, (1.5, 1.5): 2.0, (0.5, 0.5): 3.0, (1.5, 0.5): None, (9.0, 9.0): None}


def test_utm(spark):
    places = [(80.27, 13.08, 44), (-0.1276, 51.5072, 30), (3.0, 0.0, 31)]
    table = spark.createDataFrame(places, "lon double, lat double, zone int")
    for r in table.collect():
        x, y = table.where(f"lon = {r.lon}").select(*spatial.utm(F.col("lon"), F.col("lat"), r.zone)).first()
        assert table.where(f"lon = {r.lon}").select(spatial.zone_of(F.col("lon"))).first()[0] == r.zone
        assert 160_000 < x < 840_000
        # a step of 0.001 degrees north is the meridian's length times the scale
        x2, y2 = table.where(f"lon = {r.lon}").select(*spatial.utm(F.col("lon"), F.col("lat") + 0.001, r.zone)).first()
        arc = 111132.954 - 559.822 * math.cos(2 * math.radians(r.lat)) + 1.175 * math.cos(4 * math.radians(r.lat))
        assert abs((y2 - y) / (arc / 1000) - 1) < 0.002
    x, y = table.where("lat = 0").select(*spatial.utm(F.col("lon"), F.col("lat"), 31)).first()
    assert abs(x - 500_000) < 1e-6 and abs(y) < 1e-6


def test_homography_and_tables(spark):
    h = [1.1, 0.2, 3.0, -0.1, 0.9, 5.0, 1e-4, 2e-4]

    def image(x, y):
        w = h[6] * x + h[7] * y + 1
        return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w

    places = [(x, y) for x in (0, 50, 100) for y in (0, 40, 90)]
    found = spatial.fit_homography([(x, y, *image(x, y)) for x, y in places])
    table = spark.createDataFrame([(20.0, 30.0)], "x double, y double")
    u, v = table.select(*spatial.apply_homography(found, F.col("x"), F.col("y"))).first()
    assert np.allclose((u, v), image(20, 30), atol=1e-6)
    depths = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (15.0,), (99.0,)], "c double")
    got = [r[0] for r in depths.select(spatial.interpolated([(10, 1.0), (0, 0.0), (20, 3.0)], F.col("c"))).collect()]
    assert got == [0.0, 0.0, 0.5, 2.0, 3.0]
    shapes = spark.createDataFrame([(None,), ([],), ([(1.0, 2.0)],), ([(1.0, 2.0), (3.5, 4.0)],)], f"g {spatial.POINTS}")
    assert [r[0] for r in shapes.select(spatial.valid_geometry(F.col("g"))).collect()] == ["missing", "empty", "short", "ok"]
    assert shapes.select(spatial.wkt_line(F.col("g"))).collect()[3][0] == "LINESTRING (1.0 2.0, 3.5 4.0)"


def test_bends_count(spark):
    bent = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0)]), (2, [(20.0, 20.0)])], f"k int, geom {spatial.POINTS}")
    boxes = spark.createDataFrame([(-1.0, 9.0, 1.0, 11.0), (4.0, 4.0, 6.0, 6.0)], "x0 double, y0 double, x1 double, y1 double")
    assert [r.k for r in spatial.lines_meeting_boxes(bent, boxes, "k", 3.0).collect()] == [1]
    assert spatial.lines_meeting_boxes(bent, boxes.where("x0 = 4"), "k", 3.0).collect() == []
    rings = spark.createDataFrame([([(-1.0, 9.0), (1.0, 9.0), (1.0, 11.0), (-1.0, 11.0)],), ([(19.0, 19.0), (21.0, 19.0), (20.0, 22.0)],)], f"ring {spatial.POINTS}")
    assert sorted(r.k for r in spatial.lines_meeting_polygons(bent, rings, "k", 3.0).collect()) == [1, 2]
    sites = spark.createDataFrame([(7, [(3.0, 0.0), (3.0, 7.0), (50.0, 7.0)]), (8, [(500.0, 500.0), (501.0, 500.0)])], f"s int, geom {spatial.POINTS}")
    got = {r.k: (r.s, r.distance) for r in spatial.nearest_lines(bent, sites, "k", "s", 1.0).collect()}
    assert got == {1: (7, 3.0), 2: (7, 13.0)}
    assert spatial.nearest_lines(bent, sites.limit(0), "k", "s", 1.0).collect() == []


def test_nearest_lines_where_sites_are_dense(spark, monkeypatch):
    import random

    rng = random.Random(4)

    def lines(n, size, near):
        return [(k, [(x := rng.uniform(0, near), y := rng.uniform(0, near)), (x + rng.uniform(-size, size), y + rng.uniform(-size, size)), (x + size, y)]) for k in range(n)]

    own = spark.createDataFrame([*lines(120, 0.4, 10), (500, [(40.0, 40.0), (41.0, 40.0)])], f"k long, geom {spatial.POINTS}")
    sites = spark.createDataFrame(lines(700, 0.3, 10), f"s long, geom {spatial.POINTS}")
    pairs = spatial.segments_of(own, "k").crossJoin(spatial.segments_of(sites, "s").toDF("s", *spatial.PARTS[4:]))
    far = spatial.segment_distance(*[F.col(c) for c in spatial.PARTS])
    want = {r.k: tuple(r.b) for r in pairs.groupBy("k").agg(F.min(F.struct(F.round(far, 9), "s")).alias("b")).collect()}
    plans, write = [], spatial.materialize

    def written(df, label="table", **more):
        if label == "nearest":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, **more)

    monkeypatch.setattr(spatial, "materialize", written)
    got = {r.k: (round(r.distance, 9), r.s) for r in spatial.nearest_lines(own, sites, "k", "s", 2.0).collect()}
    assert got == want and 30 < sum(d == 0 for d, _ in want.values()) < 121
    # several shares of the sites, and no plan sorts or deals the pairs that its join makes
    assert len(plans) > 3 and all("MapInPandas" in p[: p.index("Join ")] for p in plans)


def test_parts_meet_and_distances(spark):
    pairs = [((0, 0, 4, 4), (0, 4, 4, 0), 0.0), ((0, 0, 4, 0), (2, 0, 6, 0), 0.0), ((0, 0, 4, 0), (5, 0, 6, 0), 1.0), ((0, 0, 0, 0), (3, 4, 3, 4), 5.0), ((0, 0, 4, 0), (1, 2, 3, 2), 2.0), ((0, 0, 2, 2), (2, 2, 5, 1), 0.0)]
    table = spark.createDataFrame([tuple(map(float, a + b)) for a, b, _ in pairs], "a double, b double, c double, d double, e double, f double, g double, h double")
    assert [r[0] for r in table.select(spatial.segment_distance(*[F.col(c) for c in "abcdefgh"])).collect()] == [w for *_, w in pairs]


def test_outlines_turn_round_holes(spark):
    grid = [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]]
    mask = raster.over_threshold(pixels(spark, grid), 0.5)
    rings = raster.region_outlines(raster.mask_regions(mask)).collect()
    corners = sorted(len(r.ring) for r in rings)
    assert len({r.region for r in rings}) == 1
    area = sum(sum(a.x * b.y - b.x * a.y for a, b in zip(r.ring, r.ring[1:] + r.ring[:1])) / 2 for r in rings)
    assert area == 9 and corners[0] == 4


def test_quantiles_against_numpy(spark):
    from skein.operators import ranks

    rng = np.random.default_rng(3)
    values = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 1), ("b", 50), ("c", 333))}
    rows = [(g, float(v)) for g, own in values.items() for v in own] + [("b", None), ("d", None)]
    got = {(r.g, r.p): r.value for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    assert set(got) == {(g, p) for g in values for p in (0.0, 0.1, 0.5, 1.0)}
    assert all(abs(got[g, p] - np.quantile(values[g], p)) < 1e-9 for g, p in got)
