"""Splits, model comparison, permutation importance and overfitting checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelift.operators.linear import fit_ols, linear_expression
from panelift.operators.ordered import slice_rows
from panelift.operators.trees import bin_cuts, fit_forest, fit_gbt, predict_models_by_bins, training_rows
from panelift.session import spill

TEST_SHARE = 0.2
BUCKETS = 10_000
REPEATS = 10


def hash_split(df: DataFrame, keys: Sequence[str], share: float = TEST_SHARE, seed: int = 42, name: str = "split") -> DataFrame:
    """'train' or 'test' by a hash of the row key: the same rows whatever the partitioning."""
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(BUCKETS))
    return df.withColumn(name, F.when(bucket < int(share * BUCKETS), "test").otherwise("train"))


def modulo_split(df: DataFrame, key: str, parts: int = 5, name: str = "split") -> DataFrame:
    """Every ``parts``-th key is a test row."""
    return df.withColumn(name, F.when(F.pmod(F.col(key), F.lit(parts)) == 0, "test").otherwise("train"))


def hash_fold(df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(folds)).cast("int"))


def split_metrics(
    df: DataFrame, actual: str, predictions: Mapping[str, str], features: int, split: str = "split", segment: Sequence[str] = ()
) -> DataFrame:
    """Train and test figures per model (and segment) from one pass over the scored rows.

    ``predictions`` maps model name to prediction column.
    """
    columns = {f"_p{i}": (m, c) for i, (m, c) in enumerate(predictions.items())}
    slim = df.select(*segment, split, F.col(actual).cast("double").alias("_y"), *[F.col(c).alias(n) for n, (_, c) in columns.items()])
    long = slim.unpivot([*segment, split, "_y"], list(columns), "_m", "_p").filter("_y is not null and _p is not null")
    e = F.col("_y") - F.col("_p")
    parts = long.groupBy(*segment, "_m", split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("_y").alias("v")
    )
    of = lambda part, c: F.max(F.when(F.col(split) == part, F.col(c)))
    wide = parts.groupBy(*segment, "_m").agg(*[of(p, c).alias(f"{p}_{c}") for p in ("train", "test") for c in ("n", "mae", "mse", "v")])
    r2 = lambda p: 1 - F.try_divide(F.col(f"{p}_mse"), F.col(f"{p}_v"))
    name = F.lit(None).cast("string")
    for n, (m, _) in columns.items():
        name = F.when(F.col("_m") == n, m).otherwise(name)
    rows = F.col("train_n").cast("double")
    return wide.select(
        *segment,
        name.alias("model"),
        r2("train").alias("train_r2"),
        r2("test").alias("test_r2"),
        F.when(rows > features + 1, 1 - (1 - r2("train")) * (rows - 1) / (rows - features - 1)).alias("train_adj_r2"),
        "train_mae",
        "test_mae",
        F.sqrt("train_mse").alias("train_rmse"),
        F.sqrt("test_mse").alias("test_rmse"),
        (r2("train") - r2("test")).alias("r2_difference"),
        F.when(F.col("train_mae") > 0, F.col("test_mae") / F.col("train_mae")).otherwise(float("inf")).alias("mae_ratio"),
        F.when(r2("train") > 0, r2("test") / r2("train")).otherwise(0.0).alias("generalization"),
    )


def baseline_linear(df: DataFrame, target: str, features: Sequence[str], split: str = "split", segment: Sequence[str] = ()) -> DataFrame:
    """Linear regression fitted on the training rows, scored on both parts."""
    rows = df.na.drop(subset=[target, *features])
    fit = fit_ols(rows.filter(F.col(split) == "train"), target, features)
    scored = rows.withColumn("_linear", linear_expression(fit))
    return split_metrics(scored, target, {"linear": "_linear"}, len(features), split, segment)


def baseline_comparison(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    split: str = "split",
    segment: Sequence[str] = (),
    forest_trees: int = 100,
    boosted_trees: int = 100,
) -> DataFrame:
    """Linear, forest and boosted models fitted on the training rows and scored together.

    Both tree learners share the thresholds between bins, and each combination of bins is scored once for all its rows.
    """
    rows = spill(df.select(*dict.fromkeys([*segment, split, target, *features])).na.drop(subset=[target, *features]), "baselines")
    train = rows.filter(F.col(split) == "train")
    linear = fit_ols(train, target, features)
    cuts = bin_cuts(training_rows(train, target, features), features)
    forest = fit_forest(train, target, features, trees=forest_trees, cuts=cuts)
    boosted = fit_gbt(train, target, features, trees=boosted_trees, rate=0.3, cuts=cuts)
    scored = predict_models_by_bins(rows.withColumn("_linear", linear_expression(linear)), {"_forest": forest, "_boosted": boosted}, features)
    return split_metrics(scored, target, {"linear": "_linear", "random_forest": "_forest", "boosted_trees": "_boosted"}, len(features), split, segment)


def grade(test_r2: Column, difference: Column, ratio: Column) -> Column:
    """excellent, good, fair, poor or very_poor."""
    return (
        F.when((test_r2 > 0.8) & (difference < 0.1) & (ratio < 1.2), "excellent")
        .when((test_r2 > 0.6) & (difference < 0.15) & (ratio < 1.3), "good")
        .when((test_r2 > 0.3) & (difference < 0.2) & (ratio < 1.5), "fair")
        .when(test_r2 > 0.1, "poor")
        .otherwise("very_poor")
    )


def graded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("grade", grade(F.col("test_r2"), F.col("r2_difference"), F.col("mae_ratio")))


def baseline_overview(metrics: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Best model by test R2, with average, best and worst test figures."""
    return metrics.groupBy(*segment).agg(
        F.max_by("model", "test_r2").alias("best_model"), F.max("test_r2").alias("best_test_r2"), F.min("test_r2").alias("worst_test_r2"),
        F.avg("test_r2").alias("average_test_r2"), F.stddev_pop("test_r2").alias("std_test_r2"),
        F.avg("r2_difference").alias("mean_r2_difference"), F.min("test_mae").alias("best_test_mae"), F.max("test_mae").alias("worst_test_mae"),
        F.avg("test_mae").alias("average_test_mae"), F.count(F.lit(1)).alias("model_count"),
    )


def baseline_rank(current: DataFrame, baselines: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """How many baselines the current model's R2 beats, with a label.

    ``current`` has (segment..., r2); ``baselines`` (segment..., model, test_r2).
    """
    keys = list(segment)
    if keys:
        joined = current.select(*keys, "r2").join(baselines.select(*keys, "test_r2"), keys)
    else:
        # Both sides have one row per model.
        joined = current.select("r2", F.lit(1).alias("_k")).join(baselines.select("test_r2", F.lit(1).alias("_k")), "_k")
    beaten = joined.groupBy(*keys, "r2").agg(F.count_if(F.col("r2") > F.col("test_r2")).alias("better_than"), F.count(F.lit(1)).alias("total_baselines"))
    b, t = F.col("better_than"), F.col("total_baselines")
    label = F.when(b == t, "best").when(b >= t * 0.7, "above_average").when(b >= t * 0.3, "average").otherwise("below_average")
    return beaten.select(*keys, "r2", "better_than", "total_baselines", (b * 100 / t).alias("better_percent"), label.alias("ranking"))


def overfitting_alerts(metrics: DataFrame, r2_gap: float = 0.1, mae_ratio: float = 1.3, segment: Sequence[str] = ()) -> DataFrame:
    """One row per alert: (segment..., model, alert, severity)."""
    d, r = F.col("r2_difference"), F.col("mae_ratio")
    alert = lambda name, severity: F.struct(F.lit(name).alias("alert"), severity.alias("severity"))
    found = F.array_compact(
        F.array(
            F.when(d > r2_gap, alert("high_r2_difference", F.when(d > 0.2, "high").otherwise("medium"))),
            F.when(r > mae_ratio, alert("high_mae_ratio", F.when(r > 2.0, "high").otherwise("medium"))),
            F.when((F.col("train_r2") > 0.95) & (F.col("test_r2") < 0.8), alert("suspicious_train_fit", F.lit("high"))),
        )
    )
    return metrics.select(*segment, "model", F.explode(found).alias("_a")).select(*segment, "model", "_a.alert", "_a.severity")


def overall_risk(alerts: DataFrame, metrics: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Overall overfitting risk of every segment of ``metrics``: high with two high alerts, medium with one or two models.

    A segment without alerts has risk low.
    """
    rows = alerts.select(*segment, "model", "severity").unionByName(
        metrics.select(*segment, F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("severity"))
    )
    counted = rows.groupBy(*segment).agg(
        F.count_if(F.col("severity") == "high").alias("high_alerts"), F.count_distinct("model").alias("models_with_alerts")
    )
    h, m = F.col("high_alerts"), F.col("models_with_alerts")
    return counted.withColumn("risk", F.when(h >= 2, "high").when((h >= 1) | (m >= 2), "medium").otherwise("low"))


def overfitting_risk(metrics: DataFrame, features: int, observations: Column, segment: Sequence[str] = ()) -> DataFrame:
    """Risk of one model with its factors: (model, ..., risk, factors)."""
    d, r = F.col("r2_difference"), F.col("mae_ratio")
    suspicious = (F.col("train_r2") > 0.95) & (F.col("test_r2") < 0.7)
    risk = F.when((d > 0.2) | (r > 1.5) | suspicious, "high").when(d > 0.1, "medium").otherwise("low")
    factors = F.array_compact(
        F.array(
            F.when(d > 0.2, "large_r2_difference").when(d > 0.1, "moderate_r2_difference"),
            F.when(r > 1.5, "high_mae_ratio"),
            F.when(suspicious, "suspicious_train_fit"),
            F.when(F.lit(features) > observations * 0.1, "many_features"),
        )
    )
    return metrics.select(
        *segment, "model", "train_r2", "test_r2", "r2_difference", "mae_ratio", "generalization", risk.alias("risk"),
        F.concat_ws(",", factors).alias("factors"), (F.lit(float(features)) / observations).alias("feature_ratio"),
    )


FEISTEL_ROUNDS = 4


def feistel(i: np.ndarray, n: int, seed: int, rounds: int = FEISTEL_ROUNDS) -> np.ndarray:
    """A keyed bijection of 0..n-1: Feistel rounds on the smallest even-bit domain that holds n, with cycle-walking.

    Values that land at n or beyond are sent through the rounds again; a cycle that starts below n comes
    back below n, and with a domain under 4 n that takes fewer than four passes on average.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 + 1) & ((1 << 64) - 1)) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            left, right = right, left ^ (mixed & mask)
        return (left << np.uint64(half)) | right

    x = once(np.asarray(i, np.uint64))
    outside = x >= np.uint64(n)
    while outside.any():
        x[outside] = once(x[outside])
        outside = x >= np.uint64(n)
    return x.astype(np.int64)


def _numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(rows with _i = 0.. in key order, row count), written once to the shared folder."""
    sliced = slice_rows(df, [key])
    return spill(sliced.numbered("_i").drop("_slice", "_pos"), "numbered"), sliced.row_count


def _permuted(numbered: DataFrame, n: int, columns: Sequence[str], seed: int) -> DataFrame:
    """Row i also carries the values of row feistel(i): one equi-join on row numbers."""

    @F.pandas_udf("long")
    def source(i: pd.Series) -> pd.Series:
        return pd.Series(feistel(i.to_numpy(np.int64), n, seed))

    values = numbered.select(F.col("_i").alias("_src"), *[F.col(c).alias(f"_perm_{c}") for c in columns])
    return numbered.withColumn("_src", source("_i")).join(values, "_src").drop("_src")


def with_permuted(df: DataFrame, columns: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Add _perm_{column}: row i (by key) also carries the values of row feistel(i) (see ``feistel``)."""
    numbered, n = _numbered(df, key)
    return _permuted(numbered, n, columns, seed).select(*df.columns, *[f"_perm_{c}" for c in columns])


def importance_permutation(
    df: DataFrame, actual: str, features: Sequence[str], key: str, score, seed: int = 42, repeats: int = REPEATS
) -> DataFrame:
    """Drop of R2 after shuffling each feature: (feature, importance, importance_std, importance_rank).

    A shuffle is the keyed bijection ``feistel`` of row numbers (seed + repeat), so no repeat sorts rows.

    ``score(frame)`` adds the column 'prediction' and may use the features only; ``key`` must be unique. The mean and
    the population standard deviation are over ``repeats`` shuffles; a shuffle serves all features: every row is
    repeated once per feature with that feature replaced. Rows with the same features get one score, so they are
    folded first; for tree models ``trees.with_bin_values`` makes many rows alike.
    """
    base_rows = df.select(*dict.fromkeys([key, actual, *features]))
    spread = base_rows.agg(F.var_pop(actual)).first()[0]

    def r2(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """1 - mean squared error / variance per ``by``, from the figures of rows with the same features."""
        y = F.col(actual).cast("double")
        alike = rows.groupBy(*by, *features).agg(F.count(y).cast("double").alias("_n"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_var"))
        off = F.col("_mean") - F.col("prediction")
        total = F.when(F.col("prediction").isNotNull(), F.col("_n"))
        errors = score(alike).groupBy(*by).agg(F.try_divide(F.sum(total * (F.col("_var") + off * off)), F.sum(total)).alias("_mse"))
        return errors.select(*by, (1 - F.try_divide(F.col("_mse"), F.lit(spread).cast("double"))).alias("r2"))

    base = r2(base_rows, []).first()[0]
    found = []
    numbered, n = _numbered(base_rows.select(key, actual, *[c for c in features if c != actual]), key)  # rows are numbered once; each shuffle is one join on the numbers
    numbered = numbered.drop(key)
    for turn in range(repeats):
        rows = _permuted(numbered, n, features, seed + turn).drop("_i")
        swap = lambda f: F.struct(F.lit(f).alias("_feature"), *[F.col(f"_perm_{c}" if c == f else c).alias(c) for c in features])
        swapped = rows.select(F.col(actual), F.explode(F.array(*[swap(f) for f in features])).alias("_s")).select(actual, "_s.*")
        found += [(r["_feature"], base - r["r2"]) for r in r2(swapped, ["_feature"]).collect()]
    drops = df.sparkSession.createDataFrame(found, "feature string, importance double")
    table = drops.groupBy("feature").agg(F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("importance_std"))
    # One row per feature.
    return table.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
