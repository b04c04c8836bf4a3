"""ARMA counterfactuals against plain Hannan-Rissanen in numpy, over any number of slices."""

import numpy as np
import pytest

from panelift.operators import arma


def series(rng, n, phi, theta, c=5.0):
    e = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = c + (phi * y[t - 1] if t else 0) + e[t] + (theta * e[t - 1] if t else 0)
    return y


def plain(y, p_max, q_max, m, fixed=None):
    """Predictions of one unit: long AR(m), then every order on the common sample, least AIC."""
    n = len(y)
    lag = lambda x, k: np.concatenate([np.full(k, np.nan), x[: n - k]])
    X = np.column_stack([np.ones(n)] + [lag(y, k) for k in range(1, m + 1)])
    ok = ~np.isnan(X).any(1)
    a = np.linalg.lstsq(X[ok], y[ok], rcond=None)[0]
    eps = y - X @ a
    cols = [np.ones(n)] + [lag(y, k) for k in range(1, p_max + 1)] + [lag(eps, j) for j in range(1, q_max + 1)]
    Z = np.column_stack(cols)
    ok = ~np.isnan(Z).any(1)
    best = None
    for p, q in [fixed] if fixed else [(p, q) for p in range(p_max + 1) for q in range(q_max + 1)]:
        used = [0, *range(1, p + 1), *range(1 + p_max, 1 + p_max + q)]
        b = np.linalg.lstsq(Z[ok][:, used], y[ok], rcond=None)[0]
        rss = ((y[ok] - Z[ok][:, used] @ b) ** 2).sum()
        key = (ok.sum() * np.log(rss / ok.sum()) + 2 * len(used), p + q, p)
        if best is None or key < best[0]:
            best = (key, p, q, b)
    _, p, q, b = best
    phi, theta = b[1 : 1 + p], arma.invertible(b[1 + p :])
    out, e = np.full(n, np.nan), np.zeros(n)
    for t in range(p, n):
        u = y[t] - b[0] - sum(phi[i] * y[t - 1 - i] for i in range(p))
        e[t] = u - sum(theta[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= p)
        out[t] = y[t] - e[t]
    return p, q, out


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for unit, n, phi, theta in (("a", 600, 0.6, 0.5), ("b", 240, -0.3, 0.7), ("c", 5, 0.1, 0.1), ("d", 300, 0.0, 0.0)):
        rows += [(unit, t, float(v)) for t, v in enumerate(series(rng, n, phi, theta))]
    return spark.createDataFrame(rows, "u string, t long, y double"), rows


def test_orders_and_predictions_equal_plain_numpy(spark, frame):
    df, rows = frame
    got = arma.arma_impact(df, "y", ["t"], ["u"], slices=7).toPandas().sort_values(["u", "t"])
    for unit in ("a", "b", "d"):
        y = np.array([v for u, _, v in rows if u == unit])
        p, q, want = plain(y, arma.MAX_P, arma.MAX_Q, arma.LONG_AR)
        mine = got[got.u == unit]
        assert (mine.ar_order.iloc[0], mine.ma_order.iloc[0]) == (p, q)
        assert np.allclose(mine.prediction.to_numpy(float), want, atol=1e-6, equal_nan=True)
    assert got[got.u == "c"].prediction.isna().all()  # too few rows for any order


def test_slices_do_not_change_the_result(spark, frame):
    df, _ = frame
    one = arma.arma_impact(df, "y", ["t"], ["u"], order=(2, 2), slices=1).toPandas().sort_values(["u", "t"]).reset_index(drop=True)
    many = arma.arma_impact(df, "y", ["t"], ["u"], order=(2, 2), slices=13).toPandas().sort_values(["u", "t"]).reset_index(drop=True)
    assert np.allclose(one.prediction.to_numpy(float), many.prediction.to_numpy(float), atol=1e-8, equal_nan=True)
    assert np.allclose(one.cumulative_effect, many.cumulative_effect, atol=1e-6)


def test_one_series_without_unit_and_empty_input(spark, frame):
    df, rows = frame
    alone = arma.arma_impact(df.where("u = 'a'").drop("u"), "y", ["t"], slices=5).toPandas().sort_values("t")
    y = np.array([v for u, _, v in rows if u == "a"])
    assert np.allclose(alone.prediction.to_numpy(float), plain(y, arma.MAX_P, arma.MAX_Q, arma.LONG_AR)[2], atol=1e-6, equal_nan=True)
    assert arma.arma_impact(df.where("u = 'none'"), "y", ["t"], ["u"]).count() == 0


def test_invertible_reflects_roots():
    assert arma.invertible(np.array([-2.0])) == pytest.approx([-0.5])
    out = arma.invertible(np.array([2.5, 1.0]))
    assert (np.abs(np.roots(np.concatenate([out[::-1], [1.0]]))) >= 1 - 1e-12).all()
    assert list(arma.invertible(np.array([0.3, 0.0]))) == [0.3, 0.0]
