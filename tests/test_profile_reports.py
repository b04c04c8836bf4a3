import json
import os

import pytest
from pyspark.sql import functions as F

from panelift.operators import frequency, kpi, profiling
from panelift.operators.report import as_json, linear_report
from panelift.session import spill
from panelift.sources import reports, tables


def test_quantiles_with_a_heavy_value(spark):
    """A third of all rows share one value; groups of any size."""
    import pandas as pd

    rows = [("a", 7.0)] * 50 + [("a", float(i)) for i in range(101)] + [("b", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    p = pd.DataFrame(rows, columns=["g", "v"])
    got = {r.g: [r[f"q{i}"] for i in range(6)] for r in frequency.quantiles(df, ["v"], probabilities, ["g"], slices=7).collect()}
    for g, part in p.groupby("g"):
        assert got[g] == pytest.approx(part["v"].quantile(probabilities).tolist())
    whole = frequency.quantile_map(df, ["v"], probabilities)["v"]
    assert whole == pytest.approx(p["v"].quantile(probabilities).tolist())


def test_ranks_outside_their_bracket_are_still_exact(spark, monkeypatch):
    """With a sketch too coarse to be trusted, the full method takes over."""
    df = spark.range(20000).select(((F.col("id") * 7919) % 20011).cast("double").alias("v"), F.lit(None).cast("double").alias("empty"))
    want = df.toPandas()["v"].quantile([0.1, 0.5, 0.99]).tolist()
    assert frequency.quantile_map(df, ["v", "empty"], [0.1, 0.5, 0.99]) == {"v": pytest.approx(want)}
    monkeypatch.setattr(frequency, "_merged", lambda brackets: [(-2.0, -1.0)])
    assert frequency.quantile_map(df, ["v"], [0.1, 0.5, 0.99]) == {"v": pytest.approx(want)}


def test_top_values_plan_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    plan = frequency.top_values(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_types_of_small_frames(spark):
    df = spark.sql(
        "select timestamp'2023-01-01' + make_dt_interval(id) as date_column, cast(id as int) as other_column, id + 0.5D as numeric_column, "
        "'x' || id as categorical_column, cast(2000 + id as int) as year, cast(id as string) as month_text, id % 2 = 0 as flag from range(5)"
    )
    got = {r.variable: r.detected_type for r in profiling.detect_types(df).collect()}
    assert got == {
        "date_column": "datetime", "other_column": "integer", "numeric_column": "numeric", "categorical_column": "categorical",
        "year": "integer", "month_text": "integer", "flag": "integer",
    }


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "flat double, empty double")
    rows = {r.variable: r for r in profiling.profile_numeric(df, ["flat", "empty"]).collect()}
    assert rows["flat"].skewness is None and rows["flat"].unique_count == 1 and rows["flat"].outlier_count == 0
    assert rows["empty"].mean is None and rows["empty"].null_percent == 100 and rows["empty"].unique_count == 0
    totals = kpi.kpi_features(df, "flat", ["empty"]).first()
    assert totals.total_value == 0 and totals.roi_percent == 0


def test_wide_tables_are_described_in_one_scan(spark):
    df = spark.range(50).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(80)])
    out = profiling.describe_basic(df, df.columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert sorted((r.variable, r.min, r.max) for r in out.collect()) == sorted((f"c{i}", float(i), 49.0 + i) for i in range(80))


def test_profile_of_one_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, s string")
    row = profiling.profile_dataset(df).first()
    assert (row.row_count, row.column_count, row.total_missing, row.duplicate_rows, row.columns_with_missing) == (3, 2, 1, 1, 1)


def test_files_load_with_skips(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Key ,VALUE\n1,2.5\n2,\n")
    (tmp_path / "two.csv").write_text("key,extra col\n3,x\n")
    (tmp_path / "notes.txt").write_text("no table")
    paths = [f"{tmp_path}/one.csv", f"{tmp_path}/two.csv", f"{tmp_path}/notes.txt", f"{tmp_path}/absent.csv"]
    df, skipped = tables.load_files(spark, paths)
    assert df.columns == ["id", "key", "value", "extra_col"]
    assert [(r.id, r.key, r.value, r.extra_col) for r in df.orderBy("id").collect()] == [(0, 1, 2.5, None), (1, 2, None, None), (2, 3, None, "x")]
    assert [p for p, _ in skipped] == paths[2:]
    with pytest.raises(ValueError):
        tables.load_files(spark, paths[2:])


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 2.0, None)], "k int, v double, s string")
    tables.write_json(df, f"{tmp_path}/json")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/json").collect())
    assert '"v":null' in text and "NaN" not in text
    tables.write_predictions(df.select("k", F.lit(1.0).alias("prediction")), str(tmp_path / "p"), "Distributed Lag")
    tables.write_predictions(df.select("k", F.lit(2.0).alias("prediction")), str(tmp_path / "p"), "MLR")
    back = tables.read_predictions(spark, str(tmp_path / "p"), "k int, prediction double")
    assert {(r.model, r.prediction) for r in back.collect()} == {("Distributed Lag", 1.0), ("MLR", 2.0)}
    tables.save_model_tables(df.select("k"), df, str(tmp_path / "m"), "mlr")
    assert tables.load_model_tables(spark, str(tmp_path / "m"), "mlr")[0].count() == 2


def document(name, total, **sections):
    return {"report_metadata": {"model_name": name}, "dataset_overview": {"total": total}, **sections}


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a_comprehensive_report.json": document("MLR", 1, model_diagnostics={"r_squared": 0.1}),
        "b_comprehensive_report.json": document("VAR", 2, model_configuration={"target_variable": "y", "feature_variables": ["x", "z"]}),
        "c_comprehensive_report.json": document("MLR", 3, model_diagnostics={"r_squared": 0.9}, model_predictions={"predictions_summary": {"prediction_count": 7}}),
        "d_comprehensive_report.json": {"dataset_overview": {"total": 4}, "x": 1},
        "multicollinearity_analysis_PSM_comprehensive_report.json": {"analysis_summary": {"status": "done"}},
        "ignored.json": document("OTHER", 9),
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "e_comprehensive_report.json").write_text("{broken")
    (tmp_path / "f_comprehensive_report.json").write_text("[1, 2]")
    return str(tmp_path)


def test_reports_combined(spark, folder):
    parsed = reports.parse_reports(reports.read_report_texts(spark, folder))
    assert {(r.file[0], r.model) for r in parsed.collect()} == {("a", "MLR"), ("b", "VAR"), ("c", "MLR"), ("d", "d"), ("m", "PSM")}
    combined = reports.combine_reports(parsed)
    rows = {(r.model, r.section): json.loads(r.content) for r in combined.collect()}
    # the first model is MLR (file a); its last file (c) wins and gives the common section
    assert rows[None, "dataset_overview"] == {"total": 3}
    assert rows["MLR", "model_diagnostics"] == {"r_squared": 0.9}
    assert not any(s == "dataset_overview" for m, s in rows if m)
    assert set(rows) == {
        (None, "dataset_overview"), ("MLR", "report_metadata"), ("MLR", "model_diagnostics"), ("MLR", "model_predictions"),
        ("VAR", "report_metadata"), ("VAR", "model_configuration"), ("d", "x"), ("PSM", "analysis_summary"),
    }
    summary = {r.model: r for r in reports.report_summary(combined).collect()}
    assert summary["MLR"].r_squared == 0.9 and summary["MLR"].prediction_count == 7
    assert summary["VAR"].feature_count == 2 and summary["VAR"].target == "y"


def test_written_reports_are_read_back(spark, tmp_path):
    texts = spark.createDataFrame([("x y.json", '{"a": 1}'), ("z.json", '{"a":\n 2}')], "file string, text string")
    reports.write_report_files(texts, f"{tmp_path}/out")
    back = {r.file: json.loads(r.text) for r in reports.read_written_reports(spark, f"{tmp_path}/out").collect()}
    assert back == {"x y.json": {"a": 1}, "z.json": {"a": 2}}


def test_linear_report_as_one_document(spark):
    df = spark.range(50).select((F.col("id") * 2.0 + F.sin("id")).alias("y"), F.col("id").cast("double").alias("x"), F.cos("id").alias("z"))
    text = as_json(linear_report(df, "y", ["x", "z"])).first().report
    body = json.loads(text)
    assert float(body["coefficients"]["x"]["coefficient"]) == pytest.approx(2, abs=0.01)
    assert body["missing_data"]["y"]["missing_count"] == "0" and "variance_inflation" in body


def test_spills_live_in_the_shared_folder(spark):
    from panelift.session import scratch_root

    root = scratch_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir", root)
    stored = spill(spark.range(3), "probe")
    assert stored.count() == 3 and stored.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(os.path.join(root.split(":", 1)[-1]).lstrip("/"))
