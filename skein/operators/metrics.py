"""Evaluation: confusion counts, rank and threshold metrics, column statistics, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import ratio_or_zero
from skein.operators.ranks import quantiles


def confusion(df: DataFrame, *groups: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts and precision, recall, F1 and accuracy per group, rounded to 4; a metric of nothing is 0.0. Null groups are left out."""
    for g in groups:
        df = df.where(F.col(g).isNotNull())
    t, q = F.col(y) == 1, F.col(p) == 1
    counts = df.groupBy(*groups).agg(
        F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(t & ~q).alias("fn"), F.count_if(~t & ~q).alias("tn")
    )
    return with_metrics(counts)


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": F.round(ratio_or_zero(tp, tp + fp), 4),
            "recall": F.round(ratio_or_zero(tp, tp + fn), 4),
            # the same as 2pr/(p+r), without rounding p and r first
            "f1": F.round(ratio_or_zero(2 * tp, 2 * tp + fp + fn), 4),
            "accuracy": F.round(ratio_or_zero(tp + tn, tp + fp + fn + tn), 4),
        }
    )


def auc(df: DataFrame, *groups: str, y: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve per group by tie-averaged ranks; null where one class is missing.

    Rows are first counted by score, so the ranking window sees each distinct score once.
    """
    by_score = df.groupBy(*groups, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    below = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_score.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2))
    return ranked.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")), 4).alias("auc")
    )


def threshold_sweep(df: DataFrame, thresholds: list[float], y: str = "y_true", score: str = "score") -> DataFrame:
    """Metrics at each threshold, a row predicted positive if its score is over it.

    One pass: a row's score is turned into how many thresholds it passes, rows are counted by
    that number, and each threshold sums the counts from its place on.
    """
    cuts = sorted(thresholds)
    passes = sum((F.col(score) > F.lit(c)).cast("int") for c in cuts)
    counted = df.groupBy(passes.alias("passes")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    spark = df.sparkSession
    at = spark.createDataFrame([(float(c), k + 1) for k, c in enumerate(cuts)], "threshold double, place int")
    # one row per threshold against one row per number of thresholds passed
    both = F.broadcast(at).join(counted, F.lit(True))
    over = F.col("passes") >= F.col("place")
    counts = both.groupBy("threshold").agg(
        *[F.coalesce(F.sum(F.when(c, F.col(n)).otherwise(0)), F.lit(0)).cast("long").alias(name) for name, c, n in (("tp", over, "pos"), ("fp", over, "neg"), ("fn", ~over, "pos"), ("tn", ~over, "neg"))]
    )
    return with_metrics(counts)


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold of the best metric, the lowest among equals."""
    return sweep.orderBy(F.desc(metric), "threshold").limit(1).select("threshold", metric)


def pearson(x: str, y: str) -> Column:
    """Correlation, null where either side does not vary (a plain ``corr`` divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def group_diagnostics(df: DataFrame, *groups: str, y: str, x: str) -> DataFrame:
    """Size, share of positives in per cent, the smaller class's share, and the correlation of label and feature."""
    pct = F.avg(F.col(y).cast("double")) * 100
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.round(pct, 4).alias("pct_positive"),
        F.round(F.least(pct, 100 - pct), 4).alias("minority_pct"),
        F.round(pearson(x, y), 4).alias("corr"),
    )


def informativeness(diagnostics: DataFrame, *by: str, least_minority: float, least_corr: float) -> DataFrame:
    """How many groups vary enough, and how many of them correlate, per split."""
    mixed = F.col("minority_pct") >= least_minority
    good = mixed & (F.abs(F.col("corr")) >= least_corr)
    return diagnostics.groupBy(*by).agg(
        F.count("*").alias("n_groups"),
        F.count_if(mixed).alias("n_mixed"),
        F.count_if(good).alias("n_informative"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).cast("long").alias("rows_informative"),
    )


def verdict(val_auc: Column, val_informative: Column, test_informative: Column, least_auc: float = 0.55) -> Column:
    """What the comparison allows to say."""
    return (
        F.when((val_auc > least_auc) & (val_informative > 0) & (test_informative > 0), "supported")
        .when((val_auc > least_auc) & (val_informative > 0), "supported on validation, test inconclusive")
        .when(test_informative == 0, "inconclusive")
        .otherwise("not supported")
    )


def column_stats(df: DataFrame, *columns: str) -> DataFrame:
    """``(name, n, missing, missing_pct, min, max, mean, median)`` per column: one pass over unpivoted columns, and ranks for the medians."""
    pairs = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, value)")
    plain = long.groupBy("name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.round(F.count_if(F.col("value").isNull()) * 100.0 / F.count("*"), 4).alias("missing_pct"),
        F.round(F.min("value"), 4).alias("min"),
        F.round(F.max("value"), 4).alias("max"),
        F.round(F.avg("value"), 4).alias("mean"),
    )
    medians = quantiles(long, "name", "value", [0.5]).select("name", F.round("value", 4).alias("median"))
    return plain.join(medians, "name", "left")


def percentiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each."""
    found = quantiles(df.select(F.lit(0).alias("all"), column), "all", column, at)
    return found.select("p", F.round("value", 6).alias("value"))


def standardizers(df: DataFrame, train: Column, *columns: str) -> DataFrame:
    """One row with the mean and sample deviation of each column over training rows; a deviation of 0 or none is 1."""
    rows = df.where(train)
    out = []
    for c in columns:
        deviation = F.stddev_samp(c)
        out += [F.avg(c).alias(f"{c}_mean"), F.when(deviation > 0, deviation).otherwise(1.0).alias(f"{c}_std")]
    return rows.agg(*out)


def standardize(df: DataFrame, stats: DataFrame, *columns: str) -> DataFrame:
    """Columns less their mean, over their deviation; ``stats`` is the one row of ``standardizers``."""
    wide = df.join(F.broadcast(stats), F.lit(True))
    return wide.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in columns])


def class_balance(df: DataFrame, *groups: str, y: str) -> DataFrame:
    """Negatives per positive, 1.0 where there is no positive."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return df.groupBy(*groups).agg(neg.alias("n_neg"), pos.alias("n_pos"), F.round(F.coalesce(F.try_divide(neg.cast("double"), pos.cast("double")), F.lit(1.0)), 4).alias("pos_weight"))


def across_folds(df: DataFrame, *groups: str, metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return df.groupBy(*groups).agg(F.round(F.avg(metric), 4).alias("mean"), F.round(F.stddev_pop(metric), 4).alias("std"), F.count("*").alias("n_folds"))


def largest_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.round(F.max(F.abs(F.col(a) - F.col(b))), 6).alias("max_abs_diff"))


def reproduced(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """How many shared keys there are and on how many the two runs differ."""
    both = first.select(key, F.col(value).alias("a")).join(second.select(key, F.col(value).alias("b")), key)
    return both.agg(F.count("*").alias("n_shared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


def added_metric(report: DataFrame, metric: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows of ``report`` whose keys ``metric (*keys, value)`` has, with the value as ``name``; the others are left out."""
    return report.join(metric.select(*keys, F.col("value").alias(name)), list(keys))


def metric_rows(report: DataFrame) -> DataFrame:
    """A one-row report as ``(metric, value)``."""
    pairs = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in report.columns)
    return report.selectExpr(f"stack({len(report.columns)}, {pairs}) AS (metric, value)")
