"""Fixed effects by demeaning equal the regression with dummies; many levels need no list of them."""

import numpy as np
import pytest

from panelift.operators import causal


def dummies_fit(y, x, groups):
    """ATE and its standard error from least squares with an intercept, x and one dummy per extra level."""
    cols = [np.ones(len(y)), *x.T]
    for g in groups:
        for level in np.unique(g)[1:]:
            cols.append((g == level).astype(float))
    X = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    rank = np.linalg.matrix_rank(X)
    resid = y - X @ beta
    sigma2 = resid @ resid / (len(y) - rank)
    cov = sigma2 * np.linalg.pinv(X.T @ X)
    return beta[2], np.sqrt(cov[2, 2])


def test_two_way_equals_dummies(spark):
    rng = np.random.default_rng(2)
    n = 1500
    unit, month = rng.integers(0, 40, n), rng.integers(0, 12, n)
    treated = (unit < 15).astype(float)
    post = (month >= 6).astype(float)
    x = rng.normal(size=n)
    y = 3 * treated * post + 0.5 * x + unit * 0.3 + month * 0.7 + rng.normal(size=n)
    rows = [(f"u{u}", f"m{m}", float(t), float(p), float(v), float(w)) for u, m, t, p, v, w in zip(unit, month, treated, post, x, y)]
    df = spark.createDataFrame(rows, "unit string, month string, treated double, post double, x double, y double")
    got = causal.did_absorbed(df, "y", ["x"], ["unit", "month"]).first()
    ate, se = dummies_fit(y, np.column_stack([post, treated * post, x]), [unit, month])
    assert got.converged and got.absorbed_levels == 52
    assert got.ate == pytest.approx(ate, abs=1e-6) and got.std_error == pytest.approx(se, rel=1e-4)


def test_ten_thousand_levels(spark):
    rng = np.random.default_rng(3)
    n = 40000
    level = rng.integers(0, 10000, n)
    treated = (level % 3 == 0).astype(float)
    post = rng.integers(0, 2, n).astype(float)
    y = 2 * treated * post + (level % 97) + rng.normal(size=n)
    rows = [(f"k{k}", float(t), float(p), float(v)) for k, t, p, v in zip(level, treated, post, y)]
    df = spark.createDataFrame(rows, "key string, treated double, post double, y double")
    got = causal.did_absorbed(df, "y", absorb=["key"]).first()
    # one-way: demeaning within levels once is exact
    def within(v):
        sums = np.bincount(level, v, 10000)
        counts = np.bincount(level, minlength=10000)
        return v - (sums / np.maximum(counts, 1))[level]
    p, i, w = within(post), within(treated * post), within(y)
    X = np.column_stack([p, i])
    beta = np.linalg.solve(X.T @ X, X.T @ w)
    assert got.absorbed_levels == len(np.unique(level)) and got.rounds == 1
    assert got.ate == pytest.approx(beta[1], abs=1e-8) and abs(got.ate - 2) < 0.1


def test_dummy_names_that_meet_are_numbered(spark):
    df = spark.createDataFrame([("a b", 1.0), ("a-b", 2.0), ("a_b", 3.0), ("c", 4.0)], "kind string, y double")
    out, names = causal.dummy_columns(df, "kind")
    assert len(set(names)) == 3 and len(names) == 3
    rows = out.collect()
    assert [sum(r[n] for n in names) for r in rows] == [0.0, 1.0, 1.0, 1.0]
