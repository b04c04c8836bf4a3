"""Boosting with learnt missing directions against the same rules applied to rows directly."""

import numpy as np
import pytest

from panelift.operators import boosting


def plain_boost(x, y, trees, depth, rate, lam=1.0, min_child=1.0):
    """Exact greedy over row masks; thresholds are the distinct values; ties as the learner breaks them."""
    cuts = [np.unique(c[~np.isnan(c)]) for c in x.T]
    p = np.full(len(y), y.mean())
    for _ in range(trees):
        node = np.zeros(len(y), int)
        leaves, open_nodes = {}, {0}
        g = p - y
        for level in range(depth + 1):
            nxt = set()
            routes = {}
            for n in sorted(open_nodes):
                inside = node == n
                if not inside.any():
                    continue
                gt, ht = g[inside].sum(), inside.sum()
                best = None
                if level < depth:
                    for f in range(x.shape[1]):
                        miss = inside & np.isnan(x[:, f])
                        for left_missing in (False, True):
                            for t in cuts[f]:
                                left = inside & (x[:, f] <= t) | (miss if left_missing else False)
                                gl, hl = g[left].sum(), left.sum()
                                gr, hr = gt - gl, ht - hl
                                if hl < min_child or hr < min_child:
                                    continue
                                gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - gt * gt / (ht + lam)
                                if gain > 1e-12 * (abs(gt * gt / (ht + lam)) + 1) and (best is None or gain > best[0] + 1e-12 * abs(best[0])):
                                    best = (gain, f, t, left_missing)
                if best is None:
                    leaves[n] = -gt / (ht + lam)
                else:
                    _, f, t, left_missing = best
                    left = inside & ((x[:, f] <= t) | (np.isnan(x[:, f]) & left_missing))
                    routes[n] = (left, inside & ~left)
                    nxt |= {2 * n + 1, 2 * n + 2}
            for n, (left, right) in routes.items():
                node[left], node[right] = 2 * n + 1, 2 * n + 2
            if not nxt:
                break
            open_nodes = nxt
        p = p + rate * np.array([leaves.get(n, 0.0) for n in node])
    return p


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.integers(0, 9, size=(n, 3)).astype(float)
    gap_low = rng.random(n) < 0.2
    x[gap_low, 0] = 0.0  # rows missing feature a behave as if it were small: they belong on the left
    y = 4 * x[:, 0] + 2 * x[:, 1] + rng.normal(size=n)
    x[gap_low, 0] = np.nan
    gap_high = rng.random(n) < 0.15
    x[gap_high, 2] = np.nan
    y[gap_high] += 40  # rows missing feature c are high: they belong on the right
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (float(t),) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), x, y


def test_equals_plain_greedy(spark, table):
    df, x, y = table
    model = boosting.fit(df, "y", ["a", "b", "c"], trees=4, depth=3, rate=0.5)
    got = np.array([r[0] for r in df.select(model.expression()).collect()])
    assert np.allclose(got, plain_boost(x, y, 4, 3, 0.5))
    directions = {left for t in model.trees for (_, _, left) in t.splits.values()}
    assert directions == {True, False}


def test_missing_target_rows_and_all_missing_feature(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, None), (None, 5.0)], "a double, y double")
    model = boosting.fit(df, "y", ["a"], trees=2, depth=2)
    assert model.trees[0].splits == {} and model.base == pytest.approx(8 / 3)
