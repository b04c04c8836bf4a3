"""Sinks, model storage and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators import linear
from panelift.operators.kpi import prediction_summary
from panelift.operators.report import as_json, linear_report, section, stack_sections
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.model_queries import FEATURES, LINE_OLS, line_fit
from panelift.plans.shared import GEO, geo_orders
from panelift.session import scratch_path, spill
from panelift.sources import reports as docs
from panelift.sources.tables import load_model_tables, read_predictions, save_model_tables, write_json, write_predictions


@query("prediction_scan", f"""
with {GEO}, p as (select 'Mlr' as model, o_orderkey, o_totalprice * 0.9 as prediction from geo union all select 'VAR', o_orderkey, c_acctbal from geo)
select model, count(*) as total_predictions, {rd('avg(prediction)', 3, 'mean')}, {rd('stddev_samp(prediction)', 3, 'std')}, {rd('min(prediction)', 3, 'min')}, {rd('max(prediction)', 3, 'max')} from p group by model""")
def _prediction_scan(t: Tables):
    folder = scratch_path(t.spark, "predictions")
    rows = geo_orders(t)
    write_predictions(rows.select("o_orderkey", (F.col("o_totalprice") * 0.9).alias("prediction")), folder, "Mlr")
    write_predictions(rows.select("o_orderkey", F.col("c_acctbal").alias("prediction")), folder, "VAR")
    return rounded(prediction_summary(read_predictions(t.spark, folder, "o_orderkey long, prediction double"), "prediction"), 3)


@query("model_store", f"with {LINE_OLS} select 0 as position, 'intercept' as term, {rd('b0', 4, 'coefficient')} from beta union all select 1, 'l_quantity', {rd('b1', 4)} from beta union all select 2, 'l_discount', {rd('b2', 4)} from beta")
def _model_store(t: Tables):
    folder = scratch_path(t.spark, "models")
    fit = line_fit(t)
    save_model_tables(linear.coefficients(t.spark, fit), linear.predict(t.lineitem, fit).select("l_orderkey", "prediction"), folder, "mlr")
    return rounded(load_model_tables(t.spark, folder, "mlr")[0], 4)


@query("report_json", "select s_suppkey, case when s_suppkey % 3 = 0 then null else s_acctbal end as balance from supplier")
def _report_json(t: Tables):
    path = scratch_path(t.spark, "json")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))).alias("balance"))
    write_json(rows, path)
    return t.spark.read.schema("s_suppkey long, balance double").json(path)


def documents(t: Tables) -> DataFrame:
    """Report texts derived from the orders: one per customer and order status, some of them broken.

    The file name carries the customer; the model name inside is shared by a customer's reports.
    """
    facts = t.orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderpriority").alias("first")
    )
    body = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("model_"), F.col("o_custkey")).alias("model_name"), F.col("o_orderstatus").alias("status")).alias("report_metadata"),
            F.struct(F.col("n").alias("total_observations"), F.col("total").alias("total")).alias("dataset_overview"),
            F.struct(F.col("first").alias("target_variable"), F.array_repeat(F.lit("x"), F.col("n").cast("int")).alias("feature_variables")).alias("model_configuration"),
            F.struct((F.col("n") / (F.col("n") + 1)).alias("r_squared")).alias("model_diagnostics"),
            F.struct(F.struct(F.col("n").alias("prediction_count")).alias("predictions_summary")).alias("model_predictions"),
        )
    )
    file = F.concat(F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit("_"), F.col("o_orderstatus"), F.lit(docs.REPORT_SUFFIX))
    broken = (F.col("o_custkey") % 10 == 3) & (F.col("o_orderstatus") == "P")
    return facts.select(file.alias("file"), F.when(broken, F.lit("{not json")).otherwise(body).alias("text"))


DOCS = """facts as (select o_custkey, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderpriority) as first from orders group by all),
docs as (select *, lpad(cast(o_custkey as varchar), 12, '0') || '_' || o_orderstatus || '_comprehensive_report.json' as file, 'model_' || o_custkey as model from facts where not (o_custkey % 10 = 3 and o_orderstatus = 'P')),
lastdoc as (select * from docs qualify row_number() over (partition by model order by file desc) = 1),
firstmodel as (select model from docs order by file limit 1)"""


@query("report_scan", f"with {DOCS} select file, model, o_orderstatus as status, n as observations from docs")
def _report_scan(t: Tables):
    parsed = docs.parse_reports(documents(t))
    at = lambda path, kind: F.try_variant_get("document", path, kind)
    return parsed.select("file", "model", at("$.report_metadata.status", "string").alias("status"), at("$.dataset_overview.total_observations", "long").alias("observations"))


@query("combine_reports", f"""
with {DOCS}, s as (select unnest(['report_metadata', 'model_configuration', 'model_diagnostics', 'model_predictions']) as section)
select model, section, o_orderstatus as status from lastdoc, s
union all select null, 'dataset_overview', o_orderstatus from lastdoc where model = (select model from firstmodel)""")
def _combine_reports(t: Tables):
    # Each section is tagged with the status of the file it came from, to show which report won.
    parsed = docs.parse_reports(documents(t))
    tagged = parsed.withColumn("status", F.regexp_extract("file", "^[0-9]+_([A-Z]+)_", 1))
    combined = spill(docs.combine_reports(parsed), "combined")
    winners = tagged.groupBy("model").agg(F.max_by("status", "file").alias("status"), F.min("file").alias("_first"))
    own = combined.filter("model is not null").join(winners, "model").select("model", "section", "status")
    lead = winners.orderBy("_first").limit(1).select("status")
    shared = combined.filter("model is null").select("model", "section", F.lit(1).alias("_k")).join(lead.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return own.unionByName(shared)


@query("report_summary", f"""
with {DOCS} select model, cast(4 as bigint) as sections, first as target, cast(n as int) as feature_count, {rd('n / (n + 1.0)', 6, 'r_squared')}, n as prediction_count from lastdoc""")
def _report_summary(t: Tables):
    return rounded(docs.report_summary(docs.combine_reports(docs.parse_reports(documents(t)))), 6)


@query("model_report")
def _model_report(t: Tables):
    return linear_report(t.lineitem, "l_extendedprice", FEATURES)


@query("model_report_json", """
select n_name as unit, n_name as city_in_report, count(*) as orders_in_report from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def _model_report_json(t: Tables):
    """One JSON document per city, written through the report builder and read back."""
    per_city = geo_orders(t).groupBy("city").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    parts = [section(per_city.withColumn("unit", F.col("city")), "dataset_overview", "unit")]
    long = stack_sections(parts).withColumn("unit", F.col("item"))
    parsed = as_json(long, ["unit"])
    read = F.from_json("report", "map<string,map<string,map<string,string>>>")["dataset_overview"][F.col("unit")]
    return parsed.select("unit", read["city"].alias("city_in_report"), read["orders"].cast("long").alias("orders_in_report"))
