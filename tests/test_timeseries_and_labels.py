from datetime import date, datetime

import pytest

from skein import checks
from skein.operators import labels, timeseries
from skein.plans import queries


def series(spark):
    fine = [(datetime(2024, 1, 1, h), v) for h, v in ((0, 1.0), (5, 3.0))]
    fine += [(datetime(2024, 1, 2, h), 0.0) for h in (1, 2, 3)]  # a day whose hours sum to zero
    fine += [(datetime(2024, 1, 3, 23), 2.0), (datetime(2024, 1, 4, 0), 5.0)]  # no daily total for the 4th
    coarse = [(date(2024, 1, 1), 8.0), (date(2024, 1, 2), 24.0), (date(2024, 1, 3), 6.0)]
    return spark.createDataFrame(fine, "time timestamp_ntz, value double"), spark.createDataFrame(coarse, "date date, total double")


def test_downscale(spark):
    got = {r.time: (r.share, r.amount) for r in timeseries.downscale(*series(spark)).collect()}
    assert got[datetime(2024, 1, 1, 0)] == (0.25, 2.0)
    assert got[datetime(2024, 1, 1, 5)] == (0.75, 6.0)
    assert got[datetime(2024, 1, 2, 2)] == (1 / 24, 1.0)  # 1/24 although the day has three hours
    assert got[datetime(2024, 1, 4, 0)] == (1.0, 0.0)
    assert [tuple(r) for r in timeseries.missing_totals(*series(spark)).collect()] == [(date(2024, 1, 4), 1)]


def test_phase_totals_include_end_days_and_empty_phases(spark):
    phases = spark.createDataFrame(
        [(0, "a", date(2024, 1, 1), date(2024, 1, 3)), (1, "b", date(2024, 1, 4), date(2024, 1, 4)), (2, "c", date(2024, 2, 1), date(2024, 2, 2))],
        "phase_id int, phase_name string, start date, end date",
    )
    totals = timeseries.phase_totals(timeseries.downscale(*series(spark)), phases).orderBy("phase_id").collect()
    assert [(r.rainfall_t, r.n_hours) for r in totals] == [(17.0, 6), (0.0, 1), (0.0, 0)]


def test_running_total_sums_rounded_values(spark):
    totals = spark.createDataFrame([(0, "a", 1055.653, 504), (1, "b", 31.15, 48), (2, "c", 410.108, 48), (3, "d", 126.049, 0)], "phase_id int, phase_name string, rainfall_t double, n_hours long")
    assert [r.cumulative_rainfall_t for r in timeseries.running_total(totals).orderBy("phase_id").collect()] == [1055.653, 1086.803, 1496.911, 1622.96]
    assert [r.intensity for r in timeseries.intensity(totals).orderBy("phase_id").collect()] == [50.269, 15.575, 205.054, None]


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_fuse(spark):
    phases = queries.phases(spark).select("phase_id", "flooded", "receding")
    sources = {"sar": ids(spark, "a", "b", "b"), "news": ids(spark, "b", "c")}
    rows = labels.fuse(ids(spark, "a", "b", "c", "d"), sources, phases, ids(spark, "a", "d"), "k").collect()
    got = {(r.k, r.phase_id): (r.in_sar, r.in_news, r.n_sources, r.recovered, r.flood_label) for r in rows}
    assert len(got) == len(rows) == 16
    assert got["b", 2] == (1, 1, 2, 0, 1)
    assert got["a", 2] == (1, 0, 1, 0, 1)
    assert got["a", 3] == (1, 0, 1, 1, 0)
    assert got["d", 3] == (0, 0, 0, 1, 0)  # marked although never flooded
    assert all(got[k, 0][4] == 0 for k in "abcd")


def test_sets_and_recession(spark):
    before, still = ids(spark, "a", "b", "c", "c"), ids(spark, "c", "z")
    assert sorted(r.k for r in labels.recovered(before, still, "k").collect()) == ["a", "b"]
    assert tuple(labels.recession(before, still, "k").first()) == (3, 1, 2, 66.67)
    assert tuple(labels.recession(before.limit(0), still, "k").first()) == (0, 0, 0, 0.0)
    assert sorted(r.k for r in labels.union_of([before, still], "k").collect()) == ["a", "b", "c", "z"]


def test_transitions_have_no_last(spark):
    rows = spark.createDataFrame([("a", p, p % 2) for p in range(3)], "k string, phase_id int, flood_label int")
    phases = spark.createDataFrame([(p,) for p in range(3)], "phase_id int")
    got = sorted((r.phase_id, r.next_phase, r.y_t, r.y_next) for r in labels.transitions(rows, phases, "k").collect())
    assert got == [(0, 1, 0, 1), (1, 2, 1, 0)]


def test_staggered_reveal(spark):
    rows = [("low", 0, 1, 1.0), ("high", 0, 1, 9.0), ("none", 0, 1, None), ("off_low", 1, 0, 2.0), ("off_high", 1, 0, 8.0), ("same", 1, 1, 0.0)]
    got = labels.staggered_reveal(spark.createDataFrame(rows, "key string, y_t int, y_next int, elevation double"), steps=40)
    assert [r.key for r in got.orderBy("step").collect()] == ["low", "none", "high", "off_high", "off_low"]


def test_checks(spark):
    a, b = ids(spark, "a", "b"), ids(spark, "a")
    with pytest.raises(checks.ContractError, match="missing columns: x"):
        checks.require_columns(a, "k", "x")
    with pytest.raises(checks.ContractError, match="b"):
        checks.require_coverage(a, b, "k")
    assert checks.require_coverage(b, a, "k") is a
    rows = spark.createDataFrame([(0,), (2,)], "y int")
    with pytest.raises(checks.ContractError, match="2"):
        checks.require_binary(rows, "y")
    with pytest.raises(checks.ContractError, match="z"):
        checks.require_all(a, "k", ["a", "z"])
    with pytest.raises(checks.ContractError, match="empty"):
        checks.require_rows(a.limit(0), "the table")
