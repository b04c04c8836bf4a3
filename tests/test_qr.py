"""Least squares by tall-skinny QR against numpy on a nearly collinear table."""

import numpy as np
import pytest

from panelift.operators import gram, linear


def test_nearly_collinear_table_agrees_with_lstsq(spark):
    rng = np.random.default_rng(9)
    n = 5000
    a = rng.normal(size=n)
    b = a + 1e-5 * rng.normal(size=n)  # X'X has a condition number near 1e10 and more
    c = rng.normal(size=n) * 1e3 + 5e4
    y = 2 + 3 * a - 1 * b + 1e-3 * c + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, y double").repartition(7)
    X = np.column_stack([np.ones(n), a, b, c])
    assert np.linalg.cond(X.T @ X) > 1e9
    want, *_ = np.linalg.lstsq(X, y, rcond=None)
    fit = gram.fit_ols_qr(df, "y", ["a", "b", "c"])
    assert fit.full_rank and np.allclose(fit.coefficients, want, rtol=0, atol=1e-6 * np.abs(want).max())
    resid = y - X @ want
    assert fit.sse == pytest.approx(resid @ resid, rel=1e-8) and fit.sst == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-10)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (resid @ resid) / (n - 4))
    assert np.allclose(fit.standard_errors, se, rtol=1e-3)


def test_gaps_and_dependence(spark):
    rows = [(float(i), 2.0 * i, 1.0 + i + (i % 3)) for i in range(50)] + [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = gram.fit_ols_qr(df, "y", ["a", "b"])
    assert fit.n == 50 and not fit.full_rank
    moments = linear.fit_ols(df.na.drop().where("not isnan(a)"), "y", ["a", "b"])
    assert np.allclose(fit.intercept + 10 * fit.slopes[0] + 20 * fit.slopes[1], moments.intercept + 10 * moments.slopes[0] + 20 * moments.slopes[1])
