import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelift.operators.ordered import add_lags, add_row_id, modal_step, row_range, slice_rows, split_by_time


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit string, t int, v double")


rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "a", "a", "b", "c"]), st.one_of(st.none(), st.integers(-5, 5).map(float))), min_size=1, max_size=40
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy, st.integers(1, 9))
def test_scan_and_shift_equal_pandas(spark, rows, slices):
    """Whatever the number of slices, also when one unit fills most of them."""
    data = [(u, i, v) for i, (u, v) in enumerate(rows)]
    sliced = slice_rows(frame(spark, data), ["t"], ["unit"], slices)
    assert sliced.row_count == len(data)
    found = sliced.scan(number="n", sums={"s": "v"}, last={"l": "v"}, following={"f": "v"}).toPandas().sort_values("t").reset_index(drop=True)
    shifted = sliced.shifted({"b2": ("v", 2), "a1": ("v", -1)}).toPandas().sort_values("t").reset_index(drop=True)
    p = pd.DataFrame(data, columns=["unit", "t", "v"])
    p["v"] = p["v"].astype(float)
    g = p.groupby("unit")["v"]
    pd.testing.assert_series_equal(found["n"], p.groupby("unit").cumcount() + 1, check_names=False, check_dtype=False)
    pd.testing.assert_series_equal(found["s"].astype(float), p["v"].fillna(0).groupby(p["unit"]).cumsum(), check_names=False)
    pd.testing.assert_series_equal(found["l"].astype(float), g.ffill(), check_names=False)
    pd.testing.assert_series_equal(found["f"].astype(float), g.bfill(), check_names=False)
    pd.testing.assert_series_equal(shifted["b2"].astype(float), g.shift(2), check_names=False)
    pd.testing.assert_series_equal(shifted["a1"].astype(float), g.shift(-1), check_names=False)


def test_row_id_is_contiguous_with_ties_and_gaps(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"), F.col("id").alias("key"))
    got = add_row_id(df, ["k", "x", "key"], "rid", slices=11).toPandas().sort_values("rid")
    assert got["rid"].tolist() == list(range(500))
    want = df.toPandas().sort_values(["k", "x", "key"], na_position="last")["key"].tolist()
    assert got["key"].tolist() == want


def test_row_id_refuses_an_existing_column(spark):
    with pytest.raises(ValueError):
        add_row_id(spark.range(3), ["id"], "id")


def test_a_shared_order_key_is_spread(spark):
    """Two thirds of the rows tie in the order; the slices stay of like size and the order fixed."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 10).alias("k"), "id")
    first, again = slice_rows(df, ["k"], slices=6), slice_rows(df.repartition(3), ["k"], slices=6)
    assert len(first.sizes) == 6 and max(n for _, n in first.sizes) < 1000
    order = lambda s: [r.id for r in s.numbered("r").orderBy("r").collect()]
    assert order(first) == order(again)


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        slice_rows(spark.range(3), [])


def test_context_reaches_over_slices_with_one_row(spark):
    df = spark.range(6)
    got = slice_rows(df, ["id"], slices=6).shifted({"b3": ("id", 3), "a3": ("id", -3)}).toPandas().sort_values("id")
    assert got["b3"].fillna(-1).tolist() == [-1, -1, -1, 0, 1, 2]
    assert got["a3"].fillna(-1).tolist() == [3, 4, 5, -1, -1, -1]


def test_lags_stay_in_the_unit_unless_asked(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 3.0)])
    per_unit = add_lags(df, ["v"], 1, ["t"], ["unit"]).orderBy("t").toPandas()["v_lag1"]
    across = add_lags(df, ["v"], 1, ["t"]).orderBy("t").toPandas()["v_lag1"]
    assert per_unit.isna().tolist() == [True, False, True]
    assert across.tolist()[1:] == [1.0, 2.0]


def test_attach_equals_a_plain_join(spark):
    """Hot units, small units, a missing unit and units absent from the table."""
    rows = [("hot", i, 1.0) for i in range(60)] + [(f"u{i}", i, 1.0) for i in range(30)] + [(None, 1, 1.0), (None, 2, 1.0)]
    table = spark.createDataFrame([("hot", 1), (None, 2)] + [(f"u{i}", i) for i in range(20)], "unit string, w int")
    sliced = slice_rows(frame(spark, rows), ["t"], ["unit"], 6)
    assert sliced._crossing() is not None
    want = {None: 2, "hot": 1} | {f"u{i}": i for i in range(20)}
    left = sliced.attach(sliced.frame, table, "left").collect()
    assert len(left) == len(rows) and all(r.w == want.get(r.unit) for r in left)
    assert sliced.attach(sliced.frame, table).count() == 60 + 20 + 2
    whole = slice_rows(frame(spark, rows), ["t"], [], 6)
    assert whole.attach(whole.frame, table.filter("unit = 'hot'").drop("unit")).filter("w = 1").count() == len(rows)


def test_row_range_and_time_split(spark):
    df = spark.range(10)
    assert [r.id for r in row_range(df, ["-id"], 2, 4).orderBy("id").collect()] == [5, 6, 7]
    flags = split_by_time(df, ["id"], 0.25).orderBy("id").toPandas()["is_train"]
    assert flags.tolist() == [1] * 7 + [0] * 3


def test_modal_step_prefers_the_smallest_on_ties(spark):
    df = frame(spark, [("a", t, 0.0) for t in (1, 2, 4, 5, 7)])
    assert modal_step(df, "t", ["unit"]).first()["step"] == 1
