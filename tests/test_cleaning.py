import pytest
from pyspark.sql import functions as F

from panelift.functions import columns as col
from panelift.operators import design, filters, missing


@pytest.fixture()
def gaps(spark):
    rows = [(1, 1.0, 1.0, 1), (2, 2.0, 2.0, 2), (3, None, 3.0, 3), (4, 4.0, None, 4), (5, 5.0, 5.0, 5)]
    return spark.createDataFrame(rows, "t int, target double, feature1 double, feature2 int")


def values(df, c="target"):
    return [r[c] for r in df.orderBy("t").collect()]


def test_listwise_and_zero(gaps):
    assert missing.handle_missing(gaps, "listwise", ["target", "feature1"]).count() == 3
    filled = missing.handle_missing(gaps, "zero", ["target", "feature1"])
    assert values(filled) == [1, 2, 0, 4, 5] and values(filled, "feature1") == [1, 2, 3, 0, 5]


def test_mean_median_mode(gaps):
    assert values(missing.handle_missing(gaps, "mean", ["target"])) == [1, 2, 3, 4, 5]
    assert values(missing.handle_missing(gaps, "median", ["target"])) == [1, 2, 3, 4, 5]
    assert values(missing.handle_missing(gaps, "mode", ["target"])) == [1, 2, 1, 4, 5]


def test_fills_by_order(spark):
    rows = [(1, None), (2, 2.0), (3, None), (4, None), (5, 8.0), (6, None)]
    df = spark.createDataFrame(rows, "t int, target double")
    assert values(missing.handle_missing(df, "ffill", ["target"], ["t"])) == [0, 2, 2, 2, 8, 8]
    assert values(missing.handle_missing(df, "bfill", ["target"], ["t"])) == [2, 2, 8, 8, 8, 0]
    # the leading gap takes the mean after interpolation: (2 + 4 + 6 + 8 + 8) / 5
    assert values(missing.handle_missing(df, "interpolate", ["target"], ["t"])) == [5.6, 2, 4, 6, 8, 8]


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a"), (5, "b")], "t int, target string")
    assert values(missing.handle_missing(df, "mean", ["target"]))[2] == "a"
    assert values(missing.handle_missing(df, "zero", ["target"]))[2] == "0"
    empty = df.withColumn("target", F.lit(None).cast("string"))
    assert values(missing.handle_missing(empty, "mode", ["target"])) == ["0"] * 5


def test_unknown_method(gaps):
    with pytest.raises(ValueError):
        missing.handle_missing(gaps, "guess", ["target"])


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Column Name", " Another Column", "UPPER_CASE"])
    assert col.standardize_columns(df).columns == ["column_name", "another_column", "upper_case"]
    with pytest.raises(ValueError):
        col.standardize_columns(spark.createDataFrame([(1, 2)], ["a b", "A b"]))


def test_large_recode_map_equals_small(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("v"))
    big = {str(i): f"x{i}" for i in range(0, 300, 1)}
    got = {r.v for r in col.recode_values(df, "v", big).collect()}
    assert got == set(big.values())
    assert col.recode_values(df, "v", {"1": "one"}).filter("v = 'one'").count() == 1


def test_label_encode_unknown_becomes_first(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    test = spark.createDataFrame([("c",), ("z",)], "v string")
    assert sorted(r.v_code for r in col.label_encode(test, ["v"], train).collect()) == [0, 2]


def test_ranges(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:00:00",), ("2024-01-02 12:00:00",), ("nonsense",)], "d string")
    assert filters.date_range(df, "d", "2024-01-01", "2024-01-02").count() == 2
    assert filters.date_range(df, "d", "2024-01-01", "2024-01-02", whole_end_day=True).count() == 3
    numbers = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "n string")
    assert filters.numeric_range(numbers, "n", 1, 2).count() == 1
    assert filters.keep_values(numbers, "n", []).count() == 0
    assert filters.keep_values(numbers, "n", ["1", "x"]).count() == 2


def test_validation(spark, gaps):
    assert filters.is_trainable(gaps, "target", ["feature1"])
    assert not filters.is_trainable(gaps.limit(3), "target", ["feature1"])
    assert not filters.is_trainable(gaps, "target", ["absent"])
    assert not filters.is_trainable(gaps, "target", ["feature1"], "did")


def test_flags(spark):
    good = spark.createDataFrame([(0,), (1,)], "treated int")
    filters.assert_flags(good, ["treated"])
    for bad in ([(0,), (2,)], [(0,), (None,)], [(0,), (0,)]):
        with pytest.raises(ValueError):
            filters.assert_flags(spark.createDataFrame(bad, "treated int"), ["treated"])


def test_missing_is_never_treated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "m double")
    above = [r.treated for r in design.treated_by_quantile(df, "m", 0.5).orderBy(F.asc_nulls_last("m")).collect()]
    below = [r.treated for r in design.treated_by_quantile(df, "m", 0.5, above=False).orderBy(F.asc_nulls_last("m")).collect()]
    assert above == [0, 0, 1, 0] and below == [1, 1, 0, 0]


def test_balance_counts_an_empty_cell(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "treated int, post int")
    row = design.did_balance(df).first()
    assert row.min_cell == 0 and not row.balanced


def test_synthetic_control_needs_its_unit(spark):
    with pytest.raises(ValueError):
        design.prepare_synthetic_control(spark.createDataFrame([("a",)], "city string"), "city", "b")


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 3, "x")], "a int, b int, c string")
    assert filters.drop_constant_columns(df).columns == ["b", "c"]


def test_feature_limits(spark):
    assert filters.feature_limits_ok("var", ["a", "b", "c"])
    assert not filters.feature_limits_ok("var", [f"x{i}" for i in range(7)])
    assert not filters.feature_limits_ok("did", [])
    assert filters.feature_limits_ok("unknown", [f"x{i}" for i in range(1000)])
    df = spark.createDataFrame([(float(i), float(i), 1, 1) for i in range(10)], "target double, f double, treated int, post int")
    report = {r["check_name"]: r["passed"] for r in filters.validation_report(df, "target", ["f"] * 11, "did", limits=True).collect()}
    assert report["feature_limits"] is False and filters.is_trainable(df, "target", ["f"], "did", limits=True)
