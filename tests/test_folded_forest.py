"""Forests grown on folded bootstrap samples: what is stored and learnt from grows with combinations of bins, not with rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from panelift.operators import trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 9, 4000), rng.normal(size=4000), rng.integers(0, 50, 4000)
    y = 3 * a + np.where(b > 0.4, 20, 0) * (a > 3) + 0.1 * c + rng.normal(size=4000)
    table = [(i, float(a[i]), None if i % 17 == 0 else float(b[i]), float(c[i]), float(y[i]) if i % 29 else None) for i in range(4000)]
    return spark.createDataFrame(table, "k long, a double, b double, c double, y double")


def r2(frame, model):
    p = trees.predict_trees(frame.where("y is not null"), model, COLUMNS, "p").select("y", "p").toPandas()
    return 1 - ((p.y - p.p) ** 2).mean() / p.y.var(ddof=0)


def test_the_forest_learns_from_combinations_of_bins(spark, monkeypatch):
    many = spark.range(20_000).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.col("id").cast("double").alias("y"))
    seen, fit = [], RandomForestRegressor.fit

    def spy(self, data, *more):
        seen.append(data.count())
        return fit(self, data, *more)

    monkeypatch.setattr(RandomForestRegressor, "fit", spy)
    model = trees.fit_forest(many, "y", ["a", "b"], trees=4)
    assert len(model.trees) == model.getNumTrees == 4
    assert max(seen) <= 15 * 8  # 20,000 rows each without folding; a combination may stand in several batches


def test_a_tree_of_all_rows_equals_spark_mls(spark, rows):
    mine = trees.fit_forest(rows, "y", COLUMNS, trees=1, depth=5, bootstrap=False)
    data = trees.assemble(trees.training_rows(rows, "y", COLUMNS), COLUMNS).select("features", "y")
    whole = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=1, maxDepth=5, bootstrap=False, seed=trees.SEED).fit(data)
    both = trees.predict_trees(trees.predict_trees(rows, mine, COLUMNS, "p"), whole, COLUMNS, "q").select("p", "q").toPandas()
    assert np.allclose(both.p, both.q, rtol=1e-9)
    assert trees.tree_nodes(spark, mine)[0].rawCount.tolist() == trees.tree_nodes(spark, whole)[0].rawCount.tolist()


def test_a_forest_is_the_mean_of_its_trees_and_as_good_as_spark_mls(spark, rows):
    mine = trees.fit_forest(rows, "y", COLUMNS, trees=30, depth=6)
    data = trees.assemble(trees.training_rows(rows, "y", COLUMNS), COLUMNS).select("features", "y")
    whole = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=30, maxDepth=6, seed=trees.SEED).fit(data)
    assert abs(r2(rows, mine) - r2(rows, whole)) < 0.04
    point = trees.assemble(trees.training_rows(rows, "y", COLUMNS), COLUMNS).first().features
    assert mine.predict(point) == pytest.approx(np.mean([t.predict(point) for t in mine.trees]))
    assert len({t.predict(point) for t in mine.trees}) > 6
    assert mine.getBootstrap() and mine.getFeatureSubsetStrategy() == "auto" and mine.getNumTrees == 30


def test_samples_do_not_depend_on_partitions_and_draw_every_row_once_on_average(spark, rows):
    alike, _ = trees.alike_rows(trees.training_rows(rows, "y", COLUMNS), "y", COLUMNS)
    again, _ = trees.alike_rows(trees.training_rows(rows.repartition(7), "y", COLUMNS), "y", COLUMNS)
    bins = ["_b0", "_b1", "_b2"]

    def cells(frame, numbers):
        out = trees.bootstrap_cells(frame, "y", bins, numbers, 42).toPandas()
        for t in numbers:
            out[f"_m{t}"] *= out[f"_w{t}"]
        return out.groupby(bins).sum().sort_index()

    one, two = cells(alike, range(4)), cells(again.repartition(3), range(2, 4))
    assert np.allclose(one[two.columns], two)
    n = rows.where("y is not null").count()
    assert all(abs(one[f"_w{t}"].sum() - n) < 5 * n**0.5 for t in range(4))
    given = alike.select(*bins, "y", "_n", "_hash").toPandas()
    times = trees.poisson_draws(given["_hash"].to_numpy(np.int64).view(np.uint64)[:, None], given["_n"].to_numpy(), np.array([3], np.uint64), 42)[:, 0]
    plain = pd.DataFrame({**{b: given[b] for b in bins}, "s": times * given.y}).groupby(bins).s.sum().sort_index()
    assert np.allclose(plain, one["_m3"])


def test_draws_are_poisson():
    keys = np.arange(40_000, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for mean in (1, 7, 2500):
        drawn = trees.poisson_draws(keys, np.full(len(keys), mean), np.arange(2, dtype=np.uint64), 1)
        assert np.allclose(drawn.mean(axis=0), mean, rtol=0.03) and np.allclose(drawn.var(axis=0), mean, rtol=0.05)
        assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.02
    ones = trees.poisson_draws(keys, np.ones(len(keys), int), np.zeros(1, np.uint64), 1)
    assert [np.mean(ones == k) for k in range(3)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.01)


def test_blocks_of_trees_and_tiny_tables(spark, rows, monkeypatch):
    whole = trees.fit_forest(rows, "y", COLUMNS, trees=3, depth=3)
    monkeypatch.setattr(trees, "BLOCK_VALUES", 1)
    one = trees.fit_forest(rows, "y", COLUMNS, trees=3, depth=3)
    assert [t.toDebugString for t in one.trees] == [t.toDebugString for t in whole.trees] or r2(rows, one) == pytest.approx(r2(rows, whole))
    few = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)] * 2, "a double, b double, c double, y double")
    assert r2_free(few, trees.fit_forest(few, "y", COLUMNS, trees=12)) == [5.0, 5.0]


def r2_free(frame, model):
    return [r.p for r in trees.predict_trees(frame, model, COLUMNS, "p").collect()]
