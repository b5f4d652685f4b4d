import numpy as np
from pyspark.sql import functions as F

from skein.operators import metrics, splits


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def scores(spark, pairs):
    return rows(spark, pairs, "y_true int, y_pred int")


def test_confusion_conventions(spark):
    perfect = metrics.confusion(scores(spark, [(1, 1), (0, 0)])).first()
    assert (perfect.precision, perfect.recall, perfect.f1, perfect.accuracy) == (1.0, 1.0, 1.0, 1.0)
    wrong = metrics.confusion(scores(spark, [(1, 0), (0, 1)])).first()
    assert (wrong.precision, wrong.recall, wrong.f1, wrong.accuracy) == (0.0, 0.0, 0.0, 0.0)
    none_predicted = metrics.confusion(scores(spark, [(1, 0), (0, 0)])).first()
    assert (none_predicted.precision, none_predicted.recall, none_predicted.accuracy) == (0.0, 0.0, 0.5)
    none_present = metrics.confusion(scores(spark, [(0, 1), (0, 0)])).first()
    assert (none_present.recall, none_present.f1) == (0.0, 0.0)


def test_groups_without_rows_or_name_are_left_out(spark):
    got = metrics.confusion(rows(spark, [("train", 1, 1), (None, 1, 0)], "split string, y_true int, y_pred int"), "split").collect()
    assert [r.split for r in got] == ["train"]


def test_auc(spark):
    def auc(pairs):
        return metrics.auc(rows(spark, pairs, "y_true int, score double").withColumn("g", F.lit(1)), "g").first().auc

    assert auc([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]) == 1.0
    assert auc([(1, 0.1), (1, 0.2), (0, 0.8)]) == 0.0
    assert auc([(1, 0.5), (0, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.5), (1, 0.7)]) is None
    assert auc([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]) == 0.875


def test_sweep_is_strict_and_takes_the_lowest(spark):
    sweep = metrics.threshold_sweep(rows(spark, [(1, 0.5), (1, 0.9), (0, 0.3)], "y_true int, score double"), [0.3, 0.5, 0.8, 0.2])
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in sweep.collect()}
    assert got == {0.2: (2, 1, 0, 0), 0.3: (2, 0, 0, 1), 0.5: (1, 0, 1, 1), 0.8: (1, 0, 1, 1)}
    assert metrics.best_threshold(sweep).first().threshold == 0.3
    empty = metrics.threshold_sweep(rows(spark, [], "y_true int, score double"), [0.5])
    assert [(r.tp, r.f1) for r in empty.collect()] in ([], [(0, 0.0)])


def test_correlation_of_a_constant_is_null(spark):
    data = [("flat", 1, 5.0), ("flat", 0, 5.0), ("up", 0, 1.0), ("up", 1, 2.0), ("one", 1, 3.0)]
    got = {r.g: r for r in metrics.group_diagnostics(rows(spark, data, "g string, y int, x double"), "g", y="y", x="x").collect()}
    assert got["flat"].corr is None and got["one"].corr is None
    assert got["up"].corr == 1.0
    assert (got["up"].n, got["up"].pct_positive, got["up"].minority_pct) == (2, 50.0, 50.0)
    assert got["one"].minority_pct == 0.0


def test_verdicts(spark):
    table = rows(spark, [(0.6, 1, 1), (0.6, 1, 0), (0.5, 1, 0), (0.5, 1, 2), (0.6, 0, 1)], "a double, v int, t int")
    got = [r.w for r in table.select(metrics.verdict(F.col("a"), F.col("v"), F.col("t")).alias("w")).collect()]
    assert got == ["supported", "supported on validation, test inconclusive", "inconclusive", "not supported", "not supported"]


def test_statistics(spark):
    table = rows(spark, [(1.0, None), (2.0, 4.0), (4.0, None), (5.0, 4.0)], "a double, b double")
    got = {r.name: r for r in metrics.column_stats(table, "a", "b").collect()}
    assert (got["a"].min, got["a"].max, got["a"].mean, got["a"].median, got["a"].missing) == (1.0, 5.0, 3.0, 3.0, 0)
    assert (got["b"].missing, got["b"].missing_pct, got["b"].median) == (2, 50.0, 4.0)
    assert [r.value for r in metrics.percentiles(table, "a", [0.0, 0.25, 0.5]).collect()] == [1.0, 1.75, 3.0]


def test_standardizers_use_training_rows_only(spark):
    table = rows(spark, [(1, 1.0, 7.0), (1, 3.0, 7.0), (0, 100.0, 9.0)], "train int, x double, c double")
    stats = metrics.standardizers(table, F.col("train") == 1, "x", "c")
    assert stats.first().x_mean == 2.0 and stats.first().c_std == 1.0
    got = metrics.standardize(table, stats, "x", "c").collect()
    assert [round(r.x, 4) for r in got] == [-0.7071, 0.7071, 69.2965]
    assert [r.c for r in got] == [0.0, 0.0, 2.0]


def test_balance_folds_difference_reproduction(spark):
    table = rows(spark, [("a", 0), ("a", 0), ("a", 1), ("b", 0)], "g string, y int")
    assert {r.g: r.pos_weight for r in metrics.class_balance(table, "g", y="y").collect()} == {"a": 2.0, "b": 1.0}
    folds = rows(spark, [(0.1, 0.5), (0.1, 0.7)], "l2 double, f1 double")
    assert tuple(metrics.across_folds(folds, "l2", metric="f1").first()) == (0.1, 0.6, 0.1, 2)
    pair = rows(spark, [(1.0, 1.5), (3.0, 2.0), (None, 9.0)], "a double, b double")
    assert metrics.largest_difference(pair, "a", "b").first()[0] == 1.0
    one = rows(spark, [(1, 0.5), (2, None), (3, 1.0)], "k int, v double")
    two = rows(spark, [(1, 0.5), (2, None), (3, 2.0), (4, 1.0)], "k int, v double")
    assert tuple(metrics.reproduced(one, two, "k", "v").first()) == (3, 1)


def test_splits(spark):
    sizes = [(g, n) for g, n in zip("abcdef", (50, 20, 10, 10, 5, 5), strict=True)]
    got = dict(splits.split_by_deficit(sizes, {"train": 0.7, "val": 0.15, "test": 0.15}))
    assert got == {"a": "train", "b": "train", "c": "val", "d": "test", "e": "val", "f": "test"}
    folds = splits.folds_by_load(sizes, 3)
    assert folds == [("a", 0), ("b", 1), ("c", 2), ("d", 2), ("e", 1), ("f", 2)]
    table = rows(spark, [(g,) for g, n in sizes for _ in range(n)] + [(None,)], "g string")
    assert {r.g: r.split for r in splits.group_split(table, "g", {"train": 0.7, "val": 0.15, "test": 0.15}).collect()} == got
    seeded = [splits.group_split(table, "g", {"train": 0.7, "val": 0.3}, seed=42).collect() for _ in range(2)]
    assert seeded[0] == seeded[1]
    assert {r.g: r.fold for r in splits.group_folds(table, "g", 3).collect()} == dict(folds)


def test_leave_one_out_and_probe(spark):
    data = [(i, [float(i % 2) * 3 + i / 100, 1.0], i % 2) for i in range(40)]
    table = rows(spark, data, "id long, v array<double>, y int")
    got = splits.leave_one_out(table, "id", "v", "y").collect()
    assert len(got) == 40
    assert all((r.y_prob > 0.5) == (r.y_true == 1) for r in got)
    # the held-out row's own label must not matter
    flipped = [(i, v, 1 - y if i == 7 else y) for i, v, y in data]
    again = {r.id: r.y_prob for r in splits.leave_one_out(rows(spark, flipped, "id long, v array<double>, y int"), "id", "v", "y").collect()}
    assert abs(again[7] - {r.id: r.y_prob for r in got}[7]) < 1e-9
    model = splits.fit_probe(table, "v", "y")
    assert all((r.y_prob > 0.5) == (r.y == 1) for r in splits.predict_probe(model, table, "v").collect())


def test_leave_one_out_of_all_rows(spark, sf):
    from skein.plans import queries

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: r.y_prob for r in queries.leave_one_out(spark, sf).collect()}
    assert len(got) == vectors.count()
    table = vectors.orderBy("vec_id").collect()
    x, y = np.array([r.embedding for r in table], float), np.array([float(r.label < 5) for r in table])
    for i in (0, 7, len(y) - 1):
        assert abs(got[table[i].vec_id] - splits._left_out(x, y, i, 1.0)) < 1e-6
    many = rows(spark, [(i, [float(i % 7), float(i % 11)], int(i % 3 == 0)) for i in range(5_200)], "id long, v array<double>, y int")
    assert splits.leave_one_out(many, "id", "v", "y").count() == 5_200


def test_models_without_a_row_equal_own_fits():
    rng = np.random.default_rng(8)
    for n in (3, 4, 12, 80):
        x = np.column_stack([rng.normal(size=n) * 3 + 5, np.ones(n), np.arange(n) == 2, rng.normal(size=n)])
        y = (x[:, 0] + rng.normal(size=n) > 5).astype(float)
        got = splits.left_out_together(x, y, splits._shared_fit(x, y, 1.0), np.arange(n), 1.0)
        assert np.abs(got - [splits._left_out(x, y, i, 1.0) for i in range(n)]).max() < 1e-9


def test_grid_search(spark):
    data = [(f"g{i % 4}", [float(i % 2) * 3 + i / 100], i % 2) for i in range(40)]
    table = rows(spark, data, "g string, v array<double>, y int")
    folds = rows(spark, [("g0", 0), ("g1", 0), ("g2", 1), ("g3", 1)], "g string, fold int")
    got = splits.grid_search(table, folds, "g", "v", "y", [0.01, 0.1]).collect()
    assert sorted((r.l2, r.fold) for r in got) == [(0.01, 0), (0.01, 1), (0.1, 0), (0.1, 1)]
