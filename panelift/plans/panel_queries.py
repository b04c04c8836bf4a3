"""Sources, columns and panel preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelift.functions import columns as col
from panelift.functions.calendar import week_calendar
from panelift.operators import panel
from panelift.operators.ordered import add_row_id
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.shared import ADS, BRANDS, CALENDAR, CLIENT, COUNTS, METRICS, SUMS, VISITS, ads, visits
from panelift.session import scratch_path
from panelift.sources.tables import load_files, read_csv, write_csv

METRIC_SQL = ", ".join([*(f"sum({c}) as {c}" for c in ("grp", "ots", "ad_budget")), "cast(sum(insertions) as bigint) as insertions", "count(ad_event) as ad_events"])
METRIC_ROUNDED = ", ".join([*(rd(c, 4, c) for c in ("grp", "ots", "ad_budget")), "insertions", "ad_events"])


@query("load_union", """
with u as (select 0 as f, c_custkey as key, c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer
           union all select 1, s_suppkey, s_name, s_acctbal, null from supplier)
select row_number() over (order by f, key) - 1 as id, key, name, acctbal, segment from u""")
def _load_union(t: Tables):
    folder = scratch_path(t.spark, "csv")
    first = t.customer.select(F.col("c_custkey").alias(" Key "), F.col("c_name").alias("NAME"), F.col("c_acctbal").alias("AcctBal"), F.col("c_mktsegment").alias("Segment"))
    second = t.supplier.select(F.col("s_suppkey").alias("Key"), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("ACCTBAL "))
    write_csv(first, f"{folder}/first.csv")
    write_csv(second, f"{folder}/second.csv")
    loaded, _ = load_files(t.spark, [f"{folder}/first.csv", f"{folder}/second.csv"], order_by=["_file", "key"])
    return loaded.withColumn("key", F.col("key").cast("long"))


@query("csv_roundtrip", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem")
def _csv_roundtrip(t: Tables):
    path = scratch_path(t.spark, "csv")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    write_csv(rows, path)
    return read_csv(t.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("standardize_columns", "select p_partkey as part_key, p_brand as brand_name, p_retailprice as retail_price from part")
def _standardize_columns(t: Tables):
    raw = t.part.select("p_partkey", "p_brand", "p_retailprice").toDF(" Part Key", "BRAND name ", "Retail Price")
    return col.standardize_columns(raw)


@query("union_by_name", """
select c_custkey as key, c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer
union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def _union_by_name(t: Tables):
    first = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    second = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return col.union_by_name([first, second])


@query("row_id", "select row_number() over (order by o_orderdate, o_orderkey) - 1 as id, o_orderkey, o_orderdate from orders")
def _row_id(t: Tables):
    return add_row_id(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("rename_columns", "select p_partkey as item, p_brand as brand, p_retailprice as price from part")
def _rename_columns(t: Tables):
    return col.rename_columns(t.part.select("p_partkey", "p_brand", "p_retailprice"), {"p_partkey": "item", "p_brand": "brand", "p_retailprice": "price"})


@query("recode_values", """
select case c_mktsegment when 'BUILDING' then 'construction' when 'HOUSEHOLD' then 'home' else c_mktsegment end as segment,
       count(*) as n from customer group by 1""")
def _recode_values(t: Tables):
    recoded = col.recode_values(t.customer.select(F.col("c_mktsegment").alias("segment")), "segment", {"BUILDING": "construction", "HOUSEHOLD": "home"})
    return recoded.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("parse_week_id", f"with {VISITS} select city, year * 100 + week as week_id, year, week, visits from visits")
def _parse_week_id(t: Tables):
    raw = visits(t).select("city", (F.col("year") * 100 + F.col("week")).alias("week_id"), "visits")
    return col.parse_week_id(raw).select("city", "week_id", "year", "week", "visits")


@query("client_competitor_split", f"""
with {ADS}, gaps as (select *, case when insertions % 5 = 0 then null else brand end as b from ads)
select case when b = '{CLIENT}' then 'client' else 'competitor' end as side, count(*) as n, {rd('sum(grp)', 2, 'grp')} from gaps group by 1""")
def _client_competitor_split(t: Tables):
    gaps = ads(t).withColumn("brand", F.when(F.col("insertions") % 5 != 0, F.col("brand")))
    mine, others = panel.split_brand(gaps, CLIENT)
    total = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("grp").alias("grp"))
    return rounded(total(mine, "client").unionByName(total(others, "competitor")), 2)


def _monthly(rows):
    return rounded(panel.monthly_totals(rows, SUMS, COUNTS), 4)


@query("client_monthly", f"with {ADS} select city, month, {METRIC_ROUNDED} from (select city, month, {METRIC_SQL} from ads where brand = '{CLIENT}' group by city, month)")
def _client_monthly(t: Tables):
    return _monthly(panel.split_brand(ads(t), CLIENT)[0])


@query("competitor_monthly", f"with {ADS} select city, month, {METRIC_ROUNDED} from (select city, month, {METRIC_SQL} from ads where brand is distinct from '{CLIENT}' group by city, month)")
def _competitor_monthly(t: Tables):
    return _monthly(panel.split_brand(ads(t), CLIENT)[1])


def _brand_sql(prefix: str = "", divide: str = "") -> str:
    parts = []
    for b in BRANDS:
        n = b.replace("#", "_")
        for m in SUMS:
            value = f"coalesce(sum(case when brand = '{b}' then {m} end), 0){divide}"
            parts.append(f"cast({value} as bigint) as {n}_{m}" if m == "insertions" and not divide else rd(value, 4, f"{n}_{m}"))
    return ", ".join(parts)


@query("brand_pivot", f"with {ADS} select city, month, {_brand_sql()} from ads where brand <> '{CLIENT}' group by city, month")
def _brand_pivot(t: Tables):
    rows = ads(t)
    return rounded(panel.brand_pivot(rows, panel.distinct_brands(rows, CLIENT), SUMS), 4)


@query("week_calendar", f"with {CALENDAR} select year, week, month, weeks_in_month from calendar")
def _week_calendar(t: Tables):
    return week_calendar(t.orders.select(F.year("o_orderdate").alias("year")))


@query("monthly_to_weekly", f"""
with {ADS}, {CALENDAR}, client as (select city, month, {METRIC_SQL} from ads where brand = '{CLIENT}' group by city, month)
select city, year, week, {', '.join(rd(f'{m} / cast(weeks_in_month as double)', 6, m) for m in METRICS)} from client join calendar using (month)""")
def _monthly_to_weekly(t: Tables):
    monthly = panel.monthly_totals(panel.split_brand(ads(t), CLIENT)[0], SUMS, COUNTS)
    weekly = panel.monthly_to_weekly(monthly, t.orders.select(F.year("o_orderdate").alias("year")), METRICS)
    return rounded(weekly.select("city", "year", "week", *METRICS), 6)


@query("city_semi_join", f"""
with {ADS}, known as (select distinct n_name as city from supplier join nation on s_nationkey = n_nationkey where s_acctbal < 0)
select city, brand, count(*) as n from ads where city in (select city from known) group by city, brand""")
def _city_semi_join(t: Tables):
    known = t.supplier.filter("s_acctbal < 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("city"))
    return panel.keep_known(ads(t), known).groupBy("city", "brand").agg(F.count(F.lit(1)).alias("n"))


def _panel_sql() -> str:
    w = "cast(weeks_in_month as double)"
    own = []
    for side, test in (("client", f"brand = '{CLIENT}'"), ("competitor", f"brand is distinct from '{CLIENT}'")):
        for m in METRICS:
            value = f"count(case when {test} then ad_event end)" if m == "ad_events" else f"coalesce(sum(case when {test} then {m} end), 0)"
            own.append(f"{value} as {side}_{m}")
    brands = [f"coalesce(sum(case when brand = '{b}' then {m} end), 0) as {b.replace('#', '_')}_{m}" for b in BRANDS for m in SUMS]
    names = [x.rsplit(" as ", 1)[1] for x in [*own, *brands]]
    return f"""
with {ADS}, {VISITS}, {CALENDAR}, monthly as (select city, month, {', '.join([*own, *brands])} from ads group by city, month),
weekly as (select city, year, week, {', '.join(f'{n} / {w} as {n}' for n in names)} from monthly join calendar using (month))
select city, year, week, visits, {rd('sales', 2, 'sales')}, {rd('promo_sales', 2, 'promo_sales')},
       {', '.join(rd(f'coalesce({n}, 0)', 6, n) for n in names)}
from visits left join weekly using (city, year, week)"""


def full_panel(t: Tables):
    brands = panel.distinct_brands(t.part.select(F.col("p_brand").alias("brand")), CLIENT)
    return panel.build_panel(visits(t), ads(t), CLIENT, SUMS, COUNTS, brands, t.orders.select(F.year("o_orderdate").alias("year")))


@query("panel_join", _panel_sql())
def _panel_join(t: Tables):
    out = full_panel(t)
    activity = [c for c in out.columns if c not in ("city", "year", "week", "visits", "sales", "promo_sales")]
    return rounded(rounded(out, 2, "sales", "promo_sales"), 6, *activity).orderBy("city", "year", "week")


@query("top_brands", f"with {ADS} select brand, count(*) as n from ads where brand is not null group by brand order by n desc, brand limit 5")
def _top_brands(t: Tables):
    return panel.top_brands(ads(t))
