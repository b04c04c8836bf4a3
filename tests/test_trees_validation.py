from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelift.operators import trees, validation


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 5, 10, 0) * (x[:, 0] > 3) + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")
    model = trees.fit_gbt(df, "y", ["a", "b", "c"], trees=4, depth=3)
    return df, model


def conditional_value(rows, at, x, known):
    """Tree value when only the ``known`` features of x are used; others follow the training shares."""
    node = rows[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    f = int(node["feature"])
    left, right = int(node["leftChild"]), int(node["rightChild"])
    if f in known:
        return conditional_value(rows, left if x[f] <= node["at"][0] else right, x, known)
    share = rows[left]["rawCount"] / node["rawCount"]
    return share * conditional_value(rows, left, x, known) + (1 - share) * conditional_value(rows, right, x, known)


def test_attributions_equal_the_definition(spark, fitted):
    df, model = fitted
    nodes, weights = trees.tree_nodes(spark, model)
    by_tree = [part.set_index("id").to_dict("index") for _, part in nodes.groupby("treeID")]
    value = lambda x, s: sum(w * conditional_value(rows, 0, x, s) for rows, w in zip(by_tree, weights))
    x = np.array([[r.a, r.b, r.c] for r in df.limit(8).collect()])
    found = trees.Attribution(nodes, weights, 3)
    phi = found.explain(x)
    for row, got in zip(x, phi):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(
                factorial(n) * factorial(2 - n) / 6 * (value(row, {*s, i}) - value(row, set(s))) for n in range(3) for s in combinations(rest, n)
            )
            assert got[i] == pytest.approx(want, abs=1e-9)
        assert found.base == pytest.approx(value(row, set()))


def test_attributions_add_up_and_waterfall_ends_at_the_prediction(spark, fitted):
    df, model = fitted
    scored = trees.predict_trees(df, model, ["a", "b", "c"])
    long = trees.tree_shap(scored, model, ["a", "b", "c"], ["k", "prediction"])
    gap = long.groupBy("k", "prediction").agg((F.sum("contribution") + F.first("base_value")).alias("s"))
    assert gap.count() == 300 and gap.filter("abs(s - prediction) > 1e-9").count() == 0
    steps = trees.shap_waterfall(long, ["k", "prediction"])
    assert steps.filter("position = 3 and abs(running_total - prediction) > 1e-9").count() == 0
    sizes = steps.groupBy("k").pivot("position", [1, 2, 3]).agg(F.first(F.abs("contribution")))
    assert sizes.filter("`1` < `2` or `2` < `3`").count() == 0
    importance = trees.shap_importance(long).orderBy("importance_rank").collect()
    assert importance[0].feature == "a" and sum(r.importance_percent for r in importance) == pytest.approx(100)
    assert importance[0].concentration == pytest.approx(importance[0].importance_percent / 100)


def test_forest_attributions_with_normalized_weights(spark, fitted):
    df, _ = fitted
    forest = trees.fit_forest(df, "y", ["a", "b", "c"], trees=5, depth=3)
    scored = trees.predict_trees(df, forest, ["a", "b", "c"])
    long = trees.tree_shap(scored, forest, ["a", "b", "c"], ["k", "prediction"], normalize=True)
    gap = long.groupBy("k", "prediction").agg((F.sum("contribution") + F.first("base_value")).alias("s"))
    assert gap.filter("abs(s - prediction) > 1e-9").count() == 0


def test_split_importance(spark, fitted):
    _, model = fitted
    rows = trees.importance_tree(spark, model, ["a", "b", "c"]).orderBy("importance_rank").collect()
    assert rows[0].feature == "a" and sum(r.importance for r in rows) == pytest.approx(1)


def test_text_features_are_coded(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "g string, v double")
    coded, names = trees.encode_features(df, ["g", "v"])
    assert names == ["g_code", "v"] and {(r.g, r.g_code) for r in coded.collect()} == {("x", 0), ("y", 1)}


def test_permuted_columns_keep_their_values(spark):
    df = spark.range(200).select("id", (F.col("id") * 2.0).alias("x"), (F.col("id") % 3).cast("double").alias("z"))
    out = validation.with_permuted(df, ["x", "z"], "id").toPandas()
    assert sorted(out["_perm_x"]) == sorted(out["x"]) and (out["_perm_x"] != out["x"]).mean() > 0.9
    assert ((out["_perm_x"] / 2) % 3 == out["_perm_z"]).all()


def test_permutation_importance_finds_the_driver(spark):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 3)
    out = validation.importance_permutation(df, "y", ["a", "b"], "id", lambda f: f.withColumn("prediction", F.col("a") * 3))
    rows = {r.feature: r for r in out.collect()}
    assert rows["a"].importance > 1 and rows["a"].importance_std > 0 and rows["b"].importance == pytest.approx(0) and rows["a"].importance_rank == 1


def test_hash_split_ignores_partitioning(spark):
    df = spark.range(5000)
    first = validation.hash_split(df, ["id"]).filter("split = 'test'")
    second = validation.hash_split(df.repartition(7), ["id"]).filter("split = 'test'")
    assert {r.id for r in first.collect()} == {r.id for r in second.collect()}
    assert 850 < first.count() < 1150


def metrics(spark, rows):
    return spark.createDataFrame(rows, "model string, train_r2 double, test_r2 double, r2_difference double, mae_ratio double, generalization double")


def test_alert_rules(spark):
    table = metrics(spark, [("fine", 0.5, 0.45, 0.05, 1.1, 0.9), ("medium", 0.6, 0.45, 0.15, 1.4, 0.7), ("bad", 0.97, 0.5, 0.47, 2.5, 0.5)])
    alerts = {(r.model, r.alert): r.severity for r in validation.overfitting_alerts(table).collect()}
    assert alerts == {
        ("medium", "high_r2_difference"): "medium", ("medium", "high_mae_ratio"): "medium",
        ("bad", "high_r2_difference"): "high", ("bad", "high_mae_ratio"): "high", ("bad", "suspicious_train_fit"): "high",
    }
    assert validation.overall_risk(validation.overfitting_alerts(table), table).first().risk == "high"
    by_shop = table.withColumn("shop", F.when(F.col("model") == "fine", "a").otherwise("b"))
    shops = validation.overall_risk(validation.overfitting_alerts(by_shop, segment=["shop"]), by_shop, ["shop"])
    assert {r.shop: r.risk for r in shops.collect()} == {"a": "low", "b": "high"}
    risks = {r.model: (r.risk, r.factors) for r in validation.overfitting_risk(table, 20, F.lit(100.0)).collect()}
    assert risks["fine"] == ("low", "many_features") and risks["medium"][0] == "medium" and risks["bad"][0] == "high"
    grades = {r.model: r.grade for r in validation.graded(table).collect()}
    assert grades == {"fine": "fair", "medium": "fair", "bad": "poor"}


def test_baselines_compared(spark, fitted):
    df, _ = fitted
    split = validation.hash_split(df, ["k"])
    out = validation.baseline_comparison(split, "y", ["a", "b", "c"], forest_trees=5, boosted_trees=5)
    rows = {r.model: r for r in out.collect()}
    assert set(rows) == {"linear", "random_forest", "boosted_trees"}
    alone = validation.baseline_linear(split, "y", ["a", "b", "c"]).first()
    assert alone.test_r2 == pytest.approx(rows["linear"].test_r2) and alone.train_adj_r2 < alone.train_r2
    best = validation.baseline_overview(out).first()
    assert best.best_test_r2 == max(r.test_r2 for r in rows.values()) and best.model_count == 3
    current = spark.createDataFrame([(1.0,)], "r2 double")
    assert validation.baseline_rank(current, out).first().ranking == "best"


def test_forest_size_is_bounded_by_its_depth(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(a * 7 + b + rng.normal())) for a, b in rng.normal(size=(4000, 2)) * 100]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1)
    model = trees.fit_forest(df, "y", ["a", "b"], trees=3)
    assert model.getMaxDepth() == trees.FOREST_DEPTH
    assert all(t.depth <= trees.FOREST_DEPTH for t in model.trees)
    assert model.totalNumNodes <= 3 * (2 ** (trees.FOREST_DEPTH + 1) - 1)
    one = trees.fit_forest(df, "y", ["a"], trees=1, depth=1, bootstrap=False)
    assert one.totalNumNodes == 3  # a single split of all rows, as the SQL twin grows it


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097, 100003])
def test_feistel_is_a_bijection(n):
    for seed in (0, 42, 43):
        out = validation.feistel(np.arange(n), n, seed)
        assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        moved = validation.feistel(np.arange(n), n, 42)
        assert (moved != np.arange(n)).mean() > 0.99 and abs(np.corrcoef(moved, np.arange(n))[0, 1]) < 0.05


def test_attributions_in_blocks_equal_the_whole(spark, fitted):
    df, model = fitted
    whole = trees.tree_shap(df, model, ["a", "b", "c"], ["k"]).orderBy("k", "feature").toPandas()
    blocks = trees.tree_shap_blocks(df, model, ["a", "b", "c"], ["k"], trees_per_block=1, rows_per_block=70).orderBy("k", "feature").toPandas()
    assert len(whole) == len(blocks) == 900
    assert np.allclose(whole.contribution, blocks.contribution) and np.allclose(whole.base_value, blocks.base_value)
    assert (whole.position.to_numpy() == blocks.position.to_numpy()).all() and np.allclose(whole.running_total, blocks.running_total)
