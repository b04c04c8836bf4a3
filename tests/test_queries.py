"""Every query with a SQL twin gives exactly the twin's result; the others give rows."""

import duck
import pytest

from __spark_entry__ import entry
from panelift.plans import ORACLES, QUERIES

TREES = {"gbt_fit", "tree_shap", "shap_importance", "shap_waterfall", "importance_tree", "importance_permutation", "baseline_comparison"}


@pytest.fixture(scope="module")
def con(data):
    return duck.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    assert duck.compare(QUERIES[name](spark, data), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - TREES))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 25


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
