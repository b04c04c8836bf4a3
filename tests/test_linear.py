import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from panelift.functions.tails import f_upper, incomplete_beta, t_quantile, t_two_sided
from panelift.operators import gram, linear
from panelift.operators.collinearity import vif_values
from panelift.operators.correlation import correlation_matrix, correlation_values


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) + np.array([5.0, -2.0, 1000.0])
    y = 2 + x @ np.array([1.5, -3.0, 0.01]) + rng.normal(size=400)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y double"), x, y


def test_tails_at_known_values():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-12)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-5)
    assert f_upper(4.0, 1, 7) == pytest.approx(t_two_sided(2.0, 7), abs=1e-12)


def test_exact_line(spark):
    df = spark.createDataFrame([(float(i), i / 10) for i in range(1, 6)], "target double, feature1 double")
    fit = linear.fit_ols(df, "target", ["feature1"])
    assert fit.slopes[0] == pytest.approx(10) and fit.intercept == pytest.approx(0, abs=1e-9)


def test_dependent_features_take_the_smallest_coefficients(spark):
    rows = [(float(i), i / 10, i / 10 + 1) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "target double, feature1 double, feature2 double")
    fit = linear.fit_ols(df, "target", ["feature1", "feature2"])
    assert not fit.full_rank and np.allclose(fit.slopes, [5, 5])
    table = linear.inference(spark, fit).collect()
    assert all(r.p_value is None for r in table)
    predictions = linear.predict(df, fit).collect()
    assert len(predictions) == 10 and all(r.prediction == pytest.approx(r.target) for r in predictions)
    double = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(1, 9)], "y double, x double, z double")
    assert np.allclose(linear.fit_ols(double, "y", ["x", "z"]).slopes, [0.2, 0.4])


def test_gaps_stop_the_fit(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, None), (4.0, 4.0)], "y double, x double")
    with pytest.raises(ValueError):
        linear.fit_ols(df, "y", ["x"])
    assert linear.fit_ols(df, "y", ["x"], missing="drop").n == 2


def test_moments_paths_agree(noisy, monkeypatch):
    df, x, y = noisy
    sql = gram.moments(df, ["a", "b", "c", "y"])
    monkeypatch.setattr(gram, "SQL_WIDTH", 1)
    wide = gram.moments(df, ["a", "b", "c", "y"])
    z = np.column_stack([x, y])
    want = (z - z.mean(axis=0)).T @ (z - z.mean(axis=0))
    for m in (sql, wide):
        assert m.n == 400 and np.allclose(m.mean, z.mean(axis=0)) and np.allclose(m.cross, want)
    groups = gram.moments_by(df.withColumn("g", df.i % 3), ["a", "y"], "g")
    assert sum(m.n for m in groups.values()) == 400


def test_moments_subtract(noisy):
    df, _, _ = noisy
    whole = gram.moments(df, ["a", "y"])
    part, rest = gram.moments(df.filter("i < 100"), ["a", "y"]), gram.moments(df.filter("i >= 100"), ["a", "y"])
    left = whole.minus(part)
    assert left.n == rest.n and np.allclose(left.mean, rest.mean) and np.allclose(left.cross, rest.cross)


def test_inference_equals_spark_ml(spark, noisy):
    df, _, _ = noisy
    features = ["a", "b", "c"]
    fit = linear.fit_ols(df, "y", features)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    ml = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(data)
    s = ml.summary
    rows = {r.term: r for r in linear.inference(spark, fit).collect()}
    order = [*features, "intercept"]
    assert np.allclose([rows[t].coefficient for t in order], [*ml.coefficients, ml.intercept], rtol=1e-6)
    assert np.allclose([rows[t].std_error for t in order], s.coefficientStandardErrors, rtol=1e-6)
    assert np.allclose([rows[t].p_value for t in order], s.pValues, rtol=1e-5, atol=1e-12)
    assert fit.r2 == pytest.approx(s.r2) and fit.adjusted_r2 == pytest.approx(s.r2adj)


def test_cross_validation_equals_refits(spark, noisy):
    df, x, y = noisy
    folded = df.withColumn("fold", df.i % 5)
    scores = {r.fold: r for r in linear.cross_validation(folded, "y", ["a", "b", "c"], "fold")[0].collect()}
    for f in range(5):
        test = np.arange(400) % 5 == f
        z = np.column_stack([np.ones(400), x])
        b = np.linalg.lstsq(z[~test], y[~test], rcond=None)[0]
        e = y[test] - z[test] @ b
        assert scores[f].mae == pytest.approx(np.abs(e).mean())
        assert scores[f].r2 == pytest.approx(1 - (e @ e) / ((y[test] - y[test].mean()) ** 2).sum())


def test_vif_of_linear_combinations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, v) for i, v in zip(range(1, 6), [1.0, 3.0, 2.0, 4.0, 3.0])], "feature1 double, feature2 double, feature3 double")
    values = vif_values(gram.moments(df, ["feature1", "feature2", "feature3"]))
    assert math.isinf(values["feature1"]) and math.isinf(values["feature2"])
    assert values["feature3"] == pytest.approx(1 / (1 - 25 / 52))


def test_vif_leaves_constants_out(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "a double, flat double")
    assert vif_values(gram.moments(df, ["a", "flat"])) == {"a": 1.0}


def test_correlation_with_gaps_equals_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) * [1, 10, 1e-3, 1] + [0, 1e6, 0, 3]
    x[:, 3] = 3.0
    rows = [[None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double")
    import pandas as pd

    want = pd.DataFrame(rows, columns=list("abcd"), dtype=float).corr().to_numpy()
    got, n = correlation_values(df, df.columns)
    assert np.allclose(got[:3, :3], want[:3, :3], atol=1e-9)
    assert np.isnan(got[3]).all()
    assert correlation_matrix(df, df.columns).filter("var_i = 'flat' and corr is not null").count() == 0
    assert n[0, 0] == sum(r[0] is not None for r in rows)


def test_stars_and_lag_names(spark):
    assert [linear.stars(p) for p in (0.0001, 0.005, 0.03, 0.2, None)] == ["***", "**", "*", "", ""]
    terms = spark.createDataFrame([("x_lag3",), ("Lag 12",), ("plain",)], "term string")
    row = linear.max_lag_order(terms).first()
    assert row.max_lag == 12 and row.lag_terms == 2
