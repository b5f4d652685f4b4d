"""Splits of groups, cross-validation and linear models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.metrics import best_threshold, confusion, threshold_sweep
from skein.runtime import materialize

#: Groups that one driver-side assignment takes; more groups must be merged first.
MOST_GROUPS = 100_000


def _sizes(df: DataFrame, group: str) -> list[tuple]:
    """Groups with their sizes, largest first, then by id; there must be few enough."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    return [(r[group], r["n"]) for r in sizes]


def split_by_deficit(sizes: list[tuple], shares: dict[str, float]) -> list[tuple]:
    """Assign groups in the given order, each to the split that lacks most of its share; the first listed wins ties."""
    total = sum(n for _, n in sizes)
    have = dict.fromkeys(shares, 0)
    out = []
    for group, n in sizes:
        best = max(shares, key=lambda s: shares[s] * total - have[s])
        have[best] += n
        out.append((group, best))
    return out


def folds_by_load(sizes: list[tuple], k: int) -> list[tuple]:
    """Assign groups in the given order, each to the lightest fold."""
    load, out = [0] * k, []
    for group, n in sizes:
        best = min(range(k), key=lambda f: load[f])
        load[best] += n
        out.append((group, best))
    return out


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int | None = None) -> DataFrame:
    """``(group, split)``. Groups go largest first, or shuffled by a seed; null groups are left out."""
    sizes = [s for s in _sizes(df, group) if s[0] is not None]
    if seed is not None:
        sizes = [sizes[i] for i in np.random.default_rng(seed).permutation(len(sizes))]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(split_by_deficit(sizes, shares), f"{group} {kind}, split string")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    kind = df.schema[group].dataType.simpleString()
    sizes = [s for s in _sizes(df, group) if s[0] is not None]
    return df.sparkSession.createDataFrame(folds_by_load(sizes, k), f"{group} {kind}, fold int")


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 25) -> np.ndarray:
    """Weights and intercept of a logistic model with an L2 penalty, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], l2), 0.0)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _left_out(x: np.ndarray, y: np.ndarray, i: int, l2: float) -> float:
    """The probability of one row by a model of all others, fitted from the start."""
    rest = np.arange(len(x)) != i
    mean, deviation = x[rest].mean(0), x[rest].std(0, ddof=1)
    deviation = np.where(deviation > 0, deviation, 1.0)
    w = fit_linear((x[rest] - mean) / deviation, y[rest], l2)
    return 1 / (1 + np.exp(-np.clip(np.append((x[i] - mean) / deviation, 1.0) @ w, -30, 30)))


def _shared_fit(x: np.ndarray, y: np.ndarray, l2: float) -> tuple:
    """The model of all rows, from which those without a row start: standardised rows, weights, inverse Hessian."""
    deviation = x.std(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    z = (x - x.mean(0)) / np.where(deviation > 0, deviation, 1.0)
    w = fit_linear(z, y, l2)
    a = np.hstack([z, np.ones((len(z), 1))])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(np.append(np.full(x.shape[1], l2), 0.0) + 1e-9)
    return a, w, np.linalg.inv(hessian), deviation > 0


def left_out_together(x: np.ndarray, y: np.ndarray, shared: tuple, at: np.ndarray, l2: float, rounds: int = 40) -> np.ndarray:
    """What ``_left_out`` gives for the rows ``at``, by steps with the Hessian of all rows, many models at a time.

    Standardising without a row scales the penalty of the shared coordinates and moves the
    intercept, which has none. Rows whose steps do not settle are fitted from the start.
    """
    a, w, inverse, varies = shared
    n, z, own = len(a), a[:, :-1], a[at]
    out = np.full(len(at), np.nan)
    settled = np.zeros(len(at), bool)
    if n > 3:
        mean = (z.sum(0) - own[:, :-1]) / (n - 1)
        variance = ((z**2).sum(0) - own[:, :-1] ** 2 - (n - 1) * mean**2) / (n - 2)
        plain = (~varies | (variance > 1e-6)).all(1)  # no column is constant without the row alone
        penalty = np.hstack([l2 * np.where(varies, variance, 1.0), np.zeros((len(at), 1))])
        u = np.tile(w, (len(at), 1))
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                p = a @ u.T
                np.clip(p, -30, 30, out=p)
                np.exp(np.negative(p, out=p), out=p)
                np.reciprocal(np.add(p, 1, out=p), out=p)
                error = p[at, np.arange(len(at))] - y[at]
                p -= y[:, None]
                step = (p.T @ a - error[:, None] * own + penalty * u) @ inverse
                u -= step
                settled = np.abs(step).max(1) < 1e-11
                if settled[plain].all():
                    break
        settled &= plain
        out = 1 / (1 + np.exp(-np.clip((own * u).sum(1), -30, 30)))
    for i in np.flatnonzero(~settled).tolist():
        out[i] = _left_out(x, y, int(at[i]), l2)
    return out


#: Probabilities that a task holds while it fits models together.
HELD = 4_000_000


def leave_one_out(df: DataFrame, key: str, features: str, label: str, l2: float = 1.0) -> DataFrame:
    """``(key, y_true, y_prob)``: each row predicted by a model of all others, standardised without it.

    The whole table goes to each executor, and each row's model reads it: the work grows with
    the square of the rows and is spread over tasks, memory with the table.
    """
    rows = df.select(key, F.col(features).cast("array<double>").alias(features), F.col(label).cast("double").alias(label)).orderBy(key).toArrow()
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, y_true int, y_prob double"
    if not rows.num_rows:
        return spark.createDataFrame([], schema)
    y = rows[label].to_numpy()
    x = rows[features].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    data = spark.sparkContext.broadcast((x, y, _shared_fit(x, y, l2)))

    def predict(batches):
        x, y, shared = data.value
        many = max(1, min(256, HELD // len(y)))
        for batch in batches:
            at = batch["at"].to_numpy()
            out = [left_out_together(x, y, shared, at[i : i + many], l2) for i in range(0, len(at), many)]
            yield pd.DataFrame({key: batch[key], "y_true": batch["y_true"], "y_prob": np.concatenate(out) if out else []})

    index = spark.createDataFrame([(k, i, int(t)) for i, (k, t) in enumerate(zip(rows[key].to_pylist(), y.tolist(), strict=True))], f"{key} {kind}, at long, y_true int")
    return index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(predict, schema)


def fit_probe(df: DataFrame, features: str, label: str, weight: str | None = None, l2: float = 0.01):
    """A logistic model by Spark ML on an array column; ``weight`` is a column of row weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    model = LogisticRegression(featuresCol="__v", labelCol=label, regParam=l2, standardization=True, maxIter=50)
    return (model.setWeightCol(weight) if weight else model).fit(rows)


def predict_probe(model, df: DataFrame, features: str) -> DataFrame:
    """``df`` with ``y_prob``, the probability of the positive class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    out = model.transform(rows).withColumn("y_prob", F.element_at(vector_to_array("probability"), 2))
    return out.select(*df.columns, "y_prob")


#: Fold tables up to this many rows are broadcast, after they are counted; others are joined by a shuffle.
BROADCAST_FOLDS = 100_000


def held_out(df: DataFrame, folds: DataFrame, group: str, features: str, label: str, l2: float) -> DataFrame:
    """``(fold, y_true, score)``: each row predicted by the model of the other folds."""
    side = F.broadcast(folds) if folds.count() <= BROADCAST_FOLDS else folds
    rows = materialize(df.join(side, group).select(features, F.col(label).cast("double").alias(label), "fold"), "folds")
    out = None
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # a handful
        model = fit_probe(rows.where(F.col("fold") != fold), features, label, l2=l2)
        scored = predict_probe(model, rows.where(F.col("fold") == fold), features)
        scored = scored.select("fold", F.col(label).cast("int").alias("y_true"), F.col("y_prob").alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def grid_search(df: DataFrame, folds: DataFrame, group: str, features: str, label: str, penalties: list[float]) -> DataFrame:
    """``(l2, fold, tp, fp, fn, tn, f1, ...)`` of a model per penalty and held-out fold, cut at 0.5."""
    out = None
    for l2 in penalties:
        scored = held_out(df, folds, group, features, label, l2)
        one = confusion(scored.select(F.lit(l2).alias("l2"), "fold", "y_true", (F.col("score") > 0.5).cast("int").alias("y_pred")), "l2", "fold")
        out = one if out is None else out.unionByName(one)
    return out


def select_and_test(
    train: DataFrame, test: DataFrame, folds: DataFrame, group: str, features: str, label: str, penalties: list[float], thresholds: list[float]
) -> DataFrame:
    """``(l2, threshold, tp, ..., accuracy)``: one row, the single look at ``test`` of the model that the folds choose.

    The penalty with the best mean F1 over the folds (the first on ties) is run over them
    again, its held-out scores are pooled, and the threshold with the best pooled F1 (the lowest
    on ties) is kept. The model is then fitted on all of ``train`` and judged on ``test`` once.
    """
    searched = grid_search(train, folds, group, features, label, penalties)
    means = searched.groupBy("l2").agg(F.round(F.avg("f1"), 4).alias("mean"))
    order = F.array_position(F.array(*[F.lit(float(p)) for p in penalties]), F.col("l2"))
    l2 = means.orderBy(F.desc("mean"), order).first()["l2"]
    pooled = held_out(train, folds, group, features, label, l2)
    threshold = best_threshold(threshold_sweep(pooled, thresholds)).first()["threshold"]
    model = fit_probe(train.withColumn(label, F.col(label).cast("double")), features, label, l2=l2)
    scored = predict_probe(model, test, features)
    judged = confusion(scored.select(F.col(label).cast("int").alias("y_true"), (F.col("y_prob") > threshold).cast("int").alias("y_pred")))
    return judged.select(F.lit(l2).alias("l2"), F.lit(threshold).alias("threshold"), "*")
