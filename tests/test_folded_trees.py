"""Trees grown on folded rows are the trees of all rows; attributions and permutations go by bins."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelift.operators import trees, validation
from panelift.sources.tables import read_predictions, write_predictions

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.integers(0, 9, 4000), rng.normal(size=4000), rng.integers(0, 50, 4000)
    y = 3 * a + np.where(b > 0.4, 20, 0) * (a > 3) + 0.1 * c + rng.normal(size=4000)
    table = [(i, float(a[i]), None if i % 17 == 0 else float(b[i]), float(c[i]), float(y[i]) if i % 29 else None) for i in range(4000)]
    return spark.createDataFrame(table, "k long, a double, b double, c double, y double")


def test_folded_fit_equals_the_fit_on_rows(spark, rows):
    model = trees.fit_gbt(rows, "y", COLUMNS, trees=6, rate=0.3, depth=4)
    data = trees.assemble(trees.training_rows(rows, "y", COLUMNS), COLUMNS).select("features", "y")
    whole = GBTRegressor(featuresCol="features", labelCol="y", maxIter=6, stepSize=0.3, maxDepth=4, seed=trees.SEED).fit(data)
    both = trees.predict_trees(trees.predict_trees(rows, model, COLUMNS, "p"), whole, COLUMNS, "q").select("p", "q").toPandas()
    assert np.allclose(both.p, both.q, rtol=1e-9)
    assert np.allclose(model.featureImportances.toArray(), whole.featureImportances.toArray())
    mine, theirs = trees.tree_nodes(spark, model)[0], trees.tree_nodes(spark, whole)[0]
    assert mine.rawCount.tolist() == theirs.rawCount.tolist()
    assert mine.feature.tolist() == theirs.feature.tolist() and np.allclose(np.concatenate(list(mine["at"])), np.concatenate(list(theirs["at"])))


def test_predictions_by_bins_equal_those_by_rows(spark, rows):
    model = trees.fit_gbt(rows, "y", COLUMNS, trees=5, rate=0.3, depth=4)
    whole = trees.predict_trees(trees.predict_by_bins(rows.unionAll(rows.limit(100)), model, COLUMNS, "p"), model, COLUMNS, "q")
    assert whole.columns == [*rows.columns, "p", "q"] and whole.count() == 4100 and whole.where("not p <=> q").count() == 0


def test_the_learner_sees_combinations_of_bins_not_rows(spark):
    few = spark.range(20_000).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.col("id").cast("double").alias("y"))
    cells, cuts = trees.fold(few, "y", ["a", "b"])
    assert cells.count() == 15 and [len(c) for c in cuts] == [4, 2]
    assert cells.agg(F.sum("_weight")).first()[0] == 20_000 and cells.rdd.getNumPartitions() == 1


def test_cuts_of_many_values_share_the_rows(spark, monkeypatch):
    monkeypatch.setattr(trees, "EXACT_VALUES", 100)
    many = spark.range(20_000).select(F.col("id").cast("double").alias("a"))
    (cuts,) = trees.bin_cuts(many, ["a"])
    held = np.diff(np.concatenate([[-1], np.floor(cuts), [19_999]]))
    assert len(cuts) == 31 and held.min() > 500 and held.max() < 750


def test_attributions_of_copied_rows_and_gaps(spark, rows):
    model = trees.fit_gbt(rows, "y", COLUMNS, trees=4, rate=0.3, depth=3)
    twice = trees.predict_trees(rows.unionAll(rows.limit(500)), model, COLUMNS)
    long = trees.tree_shap_blocks(twice, model, COLUMNS, ["k", "prediction"], trees_per_block=2, rows_per_block=100)
    assert long.count() == 4500 * 3 and long.where("feature = 'b' and feature_value is null").count() == long.where("feature = 'b' and k % 17 = 0").count()
    last = long.where("position = 3")
    assert last.count() == 4500 and last.where("not abs(running_total - prediction) < 1e-9").count() == 0


def test_shuffles_score_rows_with_the_same_features_once(spark, rows):
    model = trees.fit_gbt(rows, "y", COLUMNS, trees=3, rate=0.5, depth=3)
    seen = []

    def score(frame):
        seen.append(frame.count())
        return trees.predict_trees(frame, model, COLUMNS)

    binned = trees.with_bin_values(rows, model, COLUMNS)
    found = {r.feature: r for r in validation.importance_permutation(binned, "y", COLUMNS, "k", score, repeats=2).collect()}
    assert max(seen) < 3000  # 12,000 rows without folding
    plain = validation.with_permuted(rows, COLUMNS, "k", 42).where("y is not null").toPandas()
    given = rows.where("y is not null").toPandas()
    mse = lambda f: spark.createDataFrame(f.astype(float)).transform(lambda d: trees.predict_trees(d, model, COLUMNS)).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    once = validation.importance_permutation(binned, "y", COLUMNS, "k", lambda f: trees.predict_trees(f, model, COLUMNS), repeats=1)
    for r in once.collect():
        swapped = plain[["y", *COLUMNS]].assign(**{r.feature: plain[f"_perm_{r.feature}"]})
        assert r.importance == pytest.approx((mse(swapped) - mse(given[["y", *COLUMNS]])) / given.y.var(ddof=0), rel=1e-9)
    assert found["a"].importance_rank == 1


def test_model_names_come_from_paths_without_a_pattern_per_row(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0)], "k long, prediction double")
    for model in ("Mlr", "a b_predictions", "x.csv"):
        write_predictions(frame, str(tmp_path / "runs"), model)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "alone_predictions.csv").write_text("k,prediction\n1,2.0\n")
    (tmp_path / "plain" / "_x.csv").write_text("k,prediction\n1,2.0\n")
    (tmp_path / "plain" / "bare.csv").write_text("k,prediction\n1,2.0\n")
    names = lambda p: sorted(r.model for r in read_predictions(spark, str(p), "k long, prediction double").collect())
    assert names(tmp_path / "runs") == ["Mlr", "a b_predictions", "x.csv"] and names(tmp_path / "plain") == ["alone", "bare"]
    plan = read_predictions(spark, str(tmp_path / "runs"), "k long, prediction double")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
