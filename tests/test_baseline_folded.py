"""The model comparison scores and learns from combinations of bins, and its figures are those of row-by-row scoring."""

import numpy as np
import pytest
from pyspark.ml.base import Transformer
from pyspark.sql import functions as F

from panelift.operators import trees, validation
from panelift.operators.linear import fit_ols, linear_expression

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    a, b = (F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 500
    frame = spark.range(20_000).select("id", a.alias("a"), b.alias("b"), (a * 2 - a * b + noise).alias("y"))
    return validation.hash_split(frame.withColumn("y", F.when(F.col("id") % 41 != 0, F.col("y"))), ["id"])


def test_each_combination_of_bins_is_scored_once(spark, rows, monkeypatch):
    seen, transform = [], Transformer.transform

    def spy(self, data, *more):
        if type(self).__name__ in ("RandomForestRegressionModel", "GBTRegressionModel"):
            seen.append(data.count())
        return transform(self, data, *more)

    monkeypatch.setattr(Transformer, "transform", spy)
    out = validation.baseline_comparison(rows, "y", FEATURES, forest_trees=3, boosted_trees=3)
    assert out.count() == 3
    assert len(seen) == 2 and max(seen) <= 15  # 20,000 rows each when every row is scored


def test_the_comparison_has_the_figures_of_row_by_row_scoring(spark, rows):
    out = {r.model: r for r in validation.baseline_comparison(rows, "y", FEATURES, forest_trees=4, boosted_trees=4).collect()}
    whole = rows.where("y is not null")
    train = whole.where("split = 'train'")
    models = {"_f": trees.fit_forest(train, "y", FEATURES, trees=4), "_g": trees.fit_gbt(train, "y", FEATURES, trees=4, rate=0.3)}
    scored = whole.withColumn("_l", linear_expression(fit_ols(train, "y", FEATURES)))
    for name, model in models.items():
        scored = trees.predict_trees(scored, model, FEATURES, name)
    plain = validation.split_metrics(scored, "y", {"linear": "_l", "random_forest": "_f", "boosted_trees": "_g"}, len(FEATURES)).collect()
    assert len(out) == len(plain) == 3
    for r in plain:
        assert {k: v for k, v in out[r.model].asDict().items() if k != "model"} == pytest.approx({k: v for k, v in r.asDict().items() if k != "model"})


def test_bins_are_found_without_python_and_as_numpy_finds_them(spark):
    cuts = [np.array([-1.5, 0.0, 0.1, 2.0]), np.array([]), np.array([-np.inf, 3.0, np.inf])]
    values = [None, float("nan"), -np.inf, np.inf, -1.5, -0.0, 0.0, 5e-324, 0.1, 0.1 + 2e-17, float(np.nextafter(0.1, 1)), 2.0, 3.0, 1e300, 1e301]
    df = spark.createDataFrame([(i, v, v, v) for i, v in enumerate(values)], "i int, x double, y double, z double")
    out = trees.with_bins(df, ["x", "y", "z"], cuts)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    filled = np.array([trees.MISSING if v is None or np.isnan(v) else v for v in values])
    got = out.orderBy("i").toPandas()
    assert out.columns == ["i", "x", "y", "z", "_b0", "_b1", "_b2"]
    for k, c in enumerate(cuts):
        assert got[f"_b{k}"].tolist() == np.searchsorted(c, filled, side="left").tolist()


def test_rows_alike_keep_their_bins_with_many_columns(spark):
    """More columns than one number holds."""
    names = [f"f{k}" for k in range(27)]
    df = spark.range(200).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40))).cast("double").alias(n) for k, n in enumerate(names)], (F.col("id") % 2).cast("double").alias("y"))
    twice = df.union(df)
    alike, cuts = trees.alike_rows(twice, "y", names)
    bins = [f"_b{k}" for k in range(27)]
    got = sorted(tuple(r) for r in alike.select(*bins, "y", "_n").collect())
    table = df.toPandas()
    numbers = [np.searchsorted(c, table[n].to_numpy(), side="left") + 1.0 for n, c in zip(names, cuts)]
    assert got == sorted((*at, y, 2) for *at, y in zip(*numbers, table.y))
    assert alike.select("_hash").distinct().count() == 200


def test_a_sample_joins_a_combination_over_batches(spark):
    many = spark.range(4_000).select((F.col("id") % 4).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    alike, _ = trees.alike_rows(many, "y", ["a"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        sample = trees.bootstrap_cells(alike.coalesce(1), "y", ["_b0"], range(3), 42).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    parts = alike.rdd.getNumPartitions() + 4
    assert len(sample) <= parts  # 80 batches
    assert abs(sample["_w1"].sum() - 4_000) < 5 * 4_000**0.5


def test_draws_with_many_means_are_inversions_of_the_hashed_share():
    rng = np.random.default_rng(3)
    keys, means = rng.integers(0, 2**63, 9_000).astype(np.uint64), rng.choice([1, 1, 1, 2, 30, 700], 9_000)
    for given in (means, np.ones(9_000, int), np.arange(9_000) % 40 + 1):
        drawn = trees.poisson_draws(keys[:, None], given, np.arange(5, dtype=np.uint64), 7)
        assert drawn.shape == (9_000, 5)
        salts = trees._scrambled(np.arange(5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        share = (trees._scrambled(trees._scrambled(keys[:, None] ^ salts)) >> np.uint64(11)).astype(float) * 2.0**-53
        for mean in np.unique(given):
            low, steps = trees._poisson_steps(float(mean))
            assert np.array_equal(drawn[given == mean], low + np.searchsorted(steps, share[given == mean], side="right"))
