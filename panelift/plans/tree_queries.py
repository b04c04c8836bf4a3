"""Boosted trees, their attributions and the model comparison.

The boosted model is fitted once per session and folder and shared by these queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators import boosting, trees, validation
from panelift.plans.catalog import Tables, query
from panelift.session import spill

FEATURES = ["l_quantity", "l_discount", "p_retailprice", "p_type"]
TARGET = "l_extendedprice"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_FITTED: dict[tuple[str, str], tuple] = {}


def encoded(t: Tables) -> tuple[DataFrame, list[str]]:
    """(stored rows with numeric features, feature columns), shared by the queries of a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, "rows")
    if key not in _FITTED:
        rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(*KEYS, TARGET, *FEATURES)
        frame, columns = trees.encode_features(rows, FEATURES)
        _FITTED[key] = (spill(frame, "trees"), columns)
    return _FITTED[key]


def fitted(t: Tables) -> tuple[DataFrame, object, list[str]]:
    """(encoded rows with prediction, model, columns)."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _FITTED:
        stored, columns = encoded(t)
        model = trees.fit_gbt(stored, TARGET, columns)
        _FITTED[key] = (trees.predict_by_bins(stored, model, columns), model, columns)
    return _FITTED[key]


def attributions(t: Tables) -> DataFrame:
    rows, model, columns = fitted(t)
    return trees.tree_shap_blocks(rows, model, columns, [*KEYS, "prediction"])


@query("gbt_fit")
def _gbt_fit(t: Tables):
    rows, _, _ = fitted(t)
    return rows.select(*KEYS, TARGET, "prediction")


@query("tree_shap")
def _tree_shap(t: Tables):
    return attributions(t)


@query("shap_importance")
def _shap_importance(t: Tables):
    return trees.shap_importance(attributions(t))


@query("shap_waterfall")
def _shap_waterfall(t: Tables):
    return trees.shap_waterfall(attributions(t), KEYS)


@query("importance_tree")
def _importance_tree(t: Tables):
    _, model, columns = fitted(t)
    return trees.importance_tree(t.spark, model, columns)


@query("importance_permutation")
def _importance_permutation(t: Tables):
    rows, model, columns = fitted(t)
    keyed = trees.with_bin_values(rows.withColumn("key", F.concat_ws("-", *KEYS)).drop("prediction"), model, columns)
    return validation.importance_permutation(keyed, TARGET, columns, "key", lambda frame: trees.predict_trees(frame, model, columns))


@query("sparse_boost_fit")
def _sparse_boost_fit(t: Tables):
    # boosting that learns a direction for missing values; every fourth discount is hidden
    rows, columns = encoded(t)
    gapped = rows.withColumn("l_discount", F.when(F.col("l_orderkey") % 4 != 0, F.col("l_discount")))
    model = boosting.fit(gapped, TARGET, columns, trees=20, depth=3)
    return gapped.select(*KEYS, TARGET, model.expression().alias("prediction"))


@query("baseline_comparison")
def _baseline_comparison(t: Tables):
    rows, columns = encoded(t)
    split = validation.hash_split(rows, KEYS)
    return validation.baseline_comparison(split, TARGET, columns, forest_trees=100, boosted_trees=100)
