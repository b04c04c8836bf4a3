"""Exponential smoothing state against a plain loop; sampled forecast intervals cover as they should."""

import numpy as np
import pytest

from panelift.operators import smoothing


def plain_states(y, season, a=smoothing.ALPHA, b=smoothing.BETA, g=smoothing.GAMMA):
    """Additive Holt-Winters written out: level, trend, seasonal terms by phase."""
    m = season or 0
    level, trend, seasons = y[0], 0.0, [0.0] * max(m, 1)
    out = [(level, trend, None)]
    for t in range(1, len(y)):
        old = seasons[t % m] if m else 0.0
        predicted = level + trend + old
        new_level = a * (y[t] - old) + (1 - a) * (level + trend)
        trend = b * (new_level - level) + (1 - b) * trend
        level = new_level
        if m:
            seasons[t % m] = g * (y[t] - level) + (1 - g) * old
        out.append((level, trend, predicted))
    return out


@pytest.fixture(scope="module")
def process(spark):
    rng = np.random.default_rng(3)
    rows, future = [], {}
    for u in range(60):
        level, trend, ys = 100.0, 0.5, []
        for _ in range(212):
            e = rng.normal() * 2
            ys.append(level + trend + e)
            level, trend = level + trend + 0.3 * e, trend + 0.03 * e
        rows += [(u, t, float(v)) for t, v in enumerate(ys[:200])]
        future[u] = ys[200:]
    return spark.createDataFrame(rows, "u long, t long, y double"), future


def test_state_equals_a_plain_loop_with_season(spark):
    rng = np.random.default_rng(1)
    y = 50 + 10 * np.sin(np.arange(300) * 2 * np.pi / 7) + rng.normal(size=300)
    df = spark.createDataFrame([(int(t), float(v)) for t, v in enumerate(y)], "t long, y double")
    got = smoothing.smoothed(df, "t", "y", season=7, slices=6).orderBy("t").toPandas()
    want = plain_states(y, 7)
    assert np.allclose(got.level, [w[0] for w in want]) and np.allclose(got.trend, [w[1] for w in want])
    assert np.allclose(got.predicted[1:], [w[2] for w in want[1:]]) and np.isnan(got.predicted[0])


def test_intervals_cover_about_eight_in_ten(spark, process):
    df, future = process
    out = smoothing.sampled_forecast(df, "t", "y", 12, ["u"], paths=200, slices=7).where("data_type = 'forecast'").toPandas()
    inside = [lo <= future[u][t - 200] <= hi for u, t, lo, hi in zip(out.u, out.t, out.lower, out.upper)]
    assert len(out) == 60 * 12 and 0.75 <= np.mean(inside) <= 0.85
    assert (out.lower <= out.predicted).all() and (out.predicted <= out.upper).all()


def test_slices_do_not_change_forecasts(spark, process):
    df, _ = process
    small = df.where("u < 5")
    one = smoothing.sampled_forecast(small, "t", "y", 6, ["u"], slices=1).orderBy("u", "t", "data_type").toPandas()
    many = smoothing.sampled_forecast(small, "t", "y", 6, ["u"], slices=11).orderBy("u", "t", "data_type").toPandas()
    for c in ("predicted", "lower", "upper"):
        assert np.allclose(one[c].to_numpy(float), many[c].to_numpy(float), equal_nan=True)


def test_single_row_and_no_unit(spark):
    df = spark.createDataFrame([(0, 5.0)], "t long, y double")
    out = smoothing.sampled_forecast(df, "t", "y", 3).where("data_type = 'forecast'").orderBy("t").toPandas()
    assert list(out.t) == [1, 2, 3] and np.allclose(out.predicted, 5.0) and np.allclose(out.lower, 5.0)
