"""Cross-validation with thousands of folds, solved beside the fold moments, against numpy."""

import numpy as np
import pytest

from panelift.operators import linear


def test_five_thousand_folds(spark):
    rng = np.random.default_rng(4)
    n = 20000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x1 - 3 * x2 + rng.normal(size=n)
    fold = rng.integers(0, 5000, n)
    df = spark.createDataFrame([(int(f), float(a), float(b), float(c)) for f, a, b, c in zip(fold, x1, x2, y)], "fold long, x1 double, x2 double, y double")
    scores, summary = linear.cross_validation(df, "y", ["x1", "x2"], "fold")
    got = {r["fold"]: r for r in scores.collect()}
    assert len(got) == len(np.unique(fold)) and summary.first()["folds"] == len(got)
    X = np.column_stack([np.ones(n), x1, x2])
    for f in list(got)[:25]:
        own = fold == f
        beta, *_ = np.linalg.lstsq(X[~own], y[~own], rcond=None)
        err = y[own] - X[own] @ beta
        assert got[f]["observations"] == own.sum()
        assert got[f]["mae"] == pytest.approx(np.abs(err).mean(), rel=1e-9)
        assert got[f]["rmse"] == pytest.approx(np.sqrt((err * err).mean()), rel=1e-7)
