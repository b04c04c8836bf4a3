import numpy as np
import pytest
from pyspark.sql import functions as F

from panelift.operators import causal, series


def test_did_equals_regression(spark):
    rng = np.random.default_rng(1)
    n = 300
    treated, post = rng.integers(0, 2, n), rng.integers(0, 2, n)
    group = rng.choice(["u", "v", "w"], n)
    y = 1 + 2 * treated + 3 * post + 4 * treated * post + (group == "v") * 5 + rng.normal(size=n)
    df = spark.createDataFrame([(int(t), int(p), str(g), float(v)) for t, p, g, v in zip(treated, post, group, y)], "treated int, post int, g string, y double")
    fit, _ = causal.did_fit(df, "y", ["g"])
    assert fit.features == ["treated", "post", "treated:post", "g_v", "g_w"]
    z = np.column_stack([np.ones(n), treated, post, treated * post, group == "v", group == "w"]).astype(float)
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    row = causal.did_effect(spark, fit).first()
    assert row.ate == pytest.approx(b[3]) and row.ci_low < 4 < row.ci_high and row.significant


def test_did_rejects_bad_flags(spark):
    with pytest.raises(ValueError):
        causal.did_fit(spark.createDataFrame([(2, 0, 1.0)], "treated int, post int, y double"), "y")


def test_synthetic_control_rule(spark):
    rows = [(0, float(x), 3.0 + 2 * x) for x in range(10)] + [(1, 4.0, 100.0)]
    df = spark.createDataFrame(rows, "treated int, x double, y double")
    plain = causal.synthetic_control(df, "y", ["x"])[1].filter("treated = 1").first()
    shifted = causal.synthetic_control(df, "y", ["x"], intercept=True)[1].filter("treated = 1").first()
    assert plain.synthetic == pytest.approx(8) and shifted.synthetic == pytest.approx(11)
    assert causal.synthetic_control(df, "y", ["x"])[1].filter("treated = 0 and actual <> synthetic").count() == 0


def test_nearest_match_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    score = rng.integers(0, 40, 200).astype(float)  # many equal scores
    score[:70] = 7.0  # a third of all rows in one place
    treated = rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, float(s), int(t), float(i)) for i, (s, t) in enumerate(zip(score, treated))], "k int, s double, treated int, y double")
    got = {r.k: r for r in causal.nearest_match(df, "s", "k", ["y"]).collect()}
    controls = np.flatnonzero(treated == 0)
    assert set(got) == set(np.flatnonzero(treated == 1).tolist())
    for k, r in got.items():
        assert r.gap == np.abs(score[controls] - score[k]).min()
        assert treated[r.match_key] == 0 and score[r.match_key] == r.match_score and r.match_y == float(r.match_key)
    itself = causal.nearest_match(df, "s", "k", pool="all").filter("k <> match_key").count()
    assert itself == 0


def test_balance_after_perfect_matching(spark):
    rows = [(i, i % 2, float(i // 2)) for i in range(40)] + [(100 + i, 0, 500.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, treated int, x double")
    row = causal.matching_balance(df, causal.nearest_match(df, "x", "k"), ["x"], "k").first()
    assert abs(row.smd_before) > 0.2 and row.smd_after == pytest.approx(0, abs=1e-12)


def simulate(seed, n=120):
    rng = np.random.default_rng(seed)
    a = np.array([[0.5, 0.1], [-0.2, 0.4]])
    y = np.zeros((n, 2))
    for t in range(1, n):
        y[t] = [1.0, 50.0] + a @ y[t - 1] + rng.normal(size=2)
    return y


def ols_var(y, p, start):
    z = np.column_stack([np.ones(len(y) - start)] + [y[start - k : len(y) - k] for k in range(1, p + 1)])
    b = np.linalg.lstsq(z, y[start:], rcond=None)[0]
    e = y[start:] - z @ b
    return b, e.T @ e / len(e), len(e)


@pytest.mark.parametrize("unit", [["u"], []])
def test_var_equals_least_squares(spark, unit):
    data = {"p": simulate(1), "q": simulate(2)} if unit else {"p": simulate(1)}
    rows = [(u, t, float(v[0]), float(v[1])) for u, y in data.items() for t, v in enumerate(y)]
    stats = series.VarStatistics(spark.createDataFrame(rows, "u string, t int, a double, b double"), ["a", "b"], ["t"], unit, max_lags=3)
    table, checks = stats.coefficients().toPandas(), stats.diagnostics().toPandas()
    effects = stats.impulse_responses(steps=4).toPandas()
    for u, y in data.items():
        m = y.shape[1]
        aic = []
        for p in range(4):
            _, sigma, n = ols_var(y, p, 3)
            aic.append(np.linalg.slogdet(sigma)[1] + 2 / n * (p * m * m + m))
        p = int(np.argmin(aic))
        b, sigma, n = ols_var(y, p, p)
        mine = table[table.u == u] if unit else table
        check = (checks[checks.u == u] if unit else checks).iloc[0]
        assert check.lag_order == p and check.observations == n and check.stable
        assert check.aic == pytest.approx(np.linalg.slogdet(sigma)[1] + 2 / n * (p * m * m + m))
        value = {(r.equation, r.term): r.coefficient for r in mine.itertuples()}
        names = ["const"] + [f"{v}.L{k}" for k in range(1, p + 1) for v in "ab"]
        for e, equation in enumerate("ab"):
            assert np.allclose([value[equation, term] for term in names], b[:, e], atol=1e-8)
        responses = effects[effects.u == u] if unit else effects
        first = responses[responses.step == 1].set_index(["response", "impulse"]).effect
        assert first["a", "b"] == pytest.approx(b[2, 0]) and first["b", "a"] == pytest.approx(b[1, 1])


def test_ar_impact_with_post_fits_before_only(spark):
    y = [float(2**i % 11 + i) for i in range(40)]
    y[30:] = [v + 1000 for v in y[30:]]
    df = spark.createDataFrame([(i, v, int(i >= 30)) for i, v in enumerate(y)], "t int, y double, post int")
    rows = series.ar_impact(df, "y", ["t"], order=1, post="post").orderBy("t").collect()
    x, z = np.array(y[0:29]), np.array(y[1:30])
    slope, level = np.polyfit(x, z, 1)
    assert rows[10].effect is None and rows[10].prediction == pytest.approx(level + slope * y[9])
    assert rows[30].effect == pytest.approx(y[30] - (level + slope * y[29]))
    assert rows[39].cumulative_effect == pytest.approx(sum(r.effect for r in rows[30:]))


def test_ar_impact_on_differences(spark):
    y = np.cumsum(np.random.default_rng(0).normal(size=60)).tolist()
    df = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    rows = series.ar_impact(df, "y", ["t"], order=1, difference=1).orderBy("t").collect()
    d = np.diff(y)
    slope, level = np.polyfit(d[:-1], d[1:], 1)
    assert rows[1].prediction is None
    assert rows[20].prediction == pytest.approx(y[19] + level + slope * (y[19] - y[18]))


def test_forecast_keeps_history_and_repeats_the_season(spark):
    df = spark.createDataFrame([("a", t, float(t % 4)) for t in range(1, 13)] + [("b", t, 5.0) for t in range(1, 13)], "u string, t int, y double")
    out = series.forecast(df, "t", "y", 6, ["u"], season=4)
    history = out.filter("data_type = 'historical'")
    assert history.count() == 24 and history.filter("actual <> predicted").count() == 0
    future = [r.predicted for r in out.filter("data_type = 'forecast' and u = 'a'").orderBy("t").collect()]
    assert future == [1, 2, 3, 0, 1, 2]
    line = series.forecast(df.filter("u = 'b'"), "t", "y", 3)
    assert [(r.t, r.predicted, r.lower) for r in line.filter("data_type = 'forecast'").orderBy("t").collect()] == [(13, 5.0, 5.0), (14, 5.0, 5.0), (15, 5.0, 5.0)]


def test_holdout_uses_the_training_part_only(spark):
    df = spark.createDataFrame([(t, float(t) if t <= 8 else 100.0) for t in range(1, 11)], "t int, y double")
    row = series.holdout_metrics(df, "t", "y", share=0.2).first()
    assert row.test_size == 2 and row.mae == pytest.approx(((100 - 9) + (100 - 10)) / 2)
    seasonal = series.holdout_metrics(df, "t", "y", share=0.2, season=2).first()
    assert seasonal.mae == pytest.approx(((100 - 7) + (100 - 8)) / 2)


def test_future_keys_by_type(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts, date'2024-01-31' as d, 5 as n, 1 as step")
    assert [str(r.d) for r in series.future_keys(df, 2, "d").collect()] == ["2024-02-01", "2024-02-02"]
    assert [r.n for r in series.future_keys(df, 2, "n").collect()] == [6, 7]
    hours = series.future_keys(df.withColumn("step", F.lit(3600)), 2, "ts")
    assert [r.ts.hour for r in hours.collect()] == [1, 2]
