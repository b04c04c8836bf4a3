"""Business views over the given tables, in Spark and as SQL text for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.functions.calendar import week_number
from panelift.plans.catalog import Tables

CLIENT = "Brand#1"
BRANDS = [f"Brand#{i}" for i in range(2, 26)]
SUMS = {"grp": "grp", "ots": "ots", "ad_budget": "ad_budget", "insertions": "insertions"}
COUNTS = {"ad_events": "ad_event"}
METRICS = [*SUMS, *COUNTS]
TREATED = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]
CUTOFF = "1998-06-30"


def geo_orders(t: Tables) -> DataFrame:
    """Orders with their customer's nation as city."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", F.col("n_name").alias("city"), "c_custkey", "c_acctbal")
    )


GEO = """geo as (
  select o_orderkey, o_orderdate, o_totalprice, o_orderpriority, n_name as city, c_custkey, c_acctbal
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def ads(t: Tables) -> DataFrame:
    """Advertising insertions: city, brand, month and metrics per line item."""
    cities = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.col("n_name").alias("city"))
    )
    return (
        t.lineitem.join(t.part.select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
        .join(cities, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "city",
            "brand",
            F.month("l_shipdate").alias("month"),
            F.col("l_quantity").alias("grp"),
            F.col("l_extendedprice").alias("ots"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("ad_budget"),
            F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber")).alias("ad_event"),
            F.col("l_linenumber").alias("insertions"),
        )
    )


ADS = """ads as (
  select n_name as city, p_brand as brand, cast(month(l_shipdate) as int) as month,
         l_quantity as grp, l_extendedprice as ots, l_extendedprice * (1 - l_discount) as ad_budget,
         case when l_orderkey % 7 = 0 then null else l_linenumber end as ad_event, l_linenumber as insertions
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
       join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def visits(t: Tables) -> DataFrame:
    """Weekly visits and sales per city."""
    day = F.col("o_orderdate").cast("date")
    return (
        geo_orders(t)
        .select("city", F.year(day).alias("year"), week_number(day).alias("week"), "o_totalprice", "o_orderpriority")
        .filter(F.col("week").between(1, 53))
        .groupBy("city", "year", "week")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.sum("o_totalprice").alias("sales"),
            F.sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).otherwise(0.0)).alias("promo_sales"),
        )
    )


def _start(year: str) -> str:
    jan1 = f"make_date(cast({year} as int), 1, 1)"
    wd = f"(isodow({jan1}) - 1)"
    return f"({jan1} + cast(case when {wd} in (1, 2, 3) then 7 - {wd} else -{wd} end as int))"


VISITS = f"""{GEO}, dated as (
  select city, o_totalprice, o_orderpriority, cast(o_orderdate as date) as d, cast(year(o_orderdate) as int) as year from geo),
visits as (
  select city, year, week, count(*) as visits, sum(o_totalprice) as sales,
         sum(case when o_orderpriority like '1%' then o_totalprice else 0.0 end) as promo_sales
  from (select *, cast(floor((d - {_start('year')}) / 7.0) + 1 as int) as week from dated)
  where week between 1 and 53 group by city, year, week)"""

CALENDAR = f"""calendar as (
  select year, week, cast(month(lo + cast(floor((hi - lo) / 2.0) as int)) as int) as month,
         count(*) over (partition by year, month(lo + cast(floor((hi - lo) / 2.0) as int))) as weeks_in_month
  from (select year, week, greatest(s, make_date(year, 1, 1)) as lo, least(s + 6, make_date(year, 12, 31)) as hi
        from (select year, week, {_start('year')} + (week - 1) * 7 as s
              from (select distinct cast(year(o_orderdate) as int) as year from orders), (select cast(unnest(range(1, 54)) as int) as week))
        where year(s) <= year))"""


def gapped(t: Tables) -> DataFrame:
    """Orders with gaps by rule: price missing at key % 7 = 0, priority at key % 11 = 0."""
    return t.orders.select(
        "o_orderkey",
        "o_orderdate",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
    )


GAPPED = """gapped as (
  select o_orderkey, o_orderdate, o_orderstatus, case when o_orderkey % 7 <> 0 then o_totalprice end as price,
         case when o_orderkey % 11 <> 0 then o_orderpriority end as priority from orders)"""


def hourly(t: Tables) -> DataFrame:
    """Hourly sum and count of events per type."""
    return (
        t.events.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
        .groupBy("event_type", "hour")
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )


HOURLY = """hourly as (
  select event_type, date_trunc('hour', ts) as hour, sum(value) as value, count(*) as n from events group by all)"""


def two_feature_ols(source: str, y: str, x1: str, x2: str, by: str = "") -> str:
    """SQL CTEs m and beta: least squares of y on two features, per group when ``by`` is given."""
    group = f"group by {by}" if by else ""
    lead = f"{by}, " if by else ""
    ok = f"{y} is not null and {x1} is not null and {x2} is not null"
    return f"""m as (
  select {lead}count(*) as n, avg({x1}) as m1, avg({x2}) as m2, avg({y}) as my,
         covar_pop({x1}, {x1}) as s11, covar_pop({x2}, {x2}) as s22, covar_pop({x1}, {x2}) as s12,
         covar_pop({x1}, {y}) as s1y, covar_pop({x2}, {y}) as s2y, covar_pop({y}, {y}) as syy
  from {source} where {ok} {group}),
beta as (
  select *, my - b1 * m1 - b2 * m2 as b0, greatest(0.0, n * (syy - b1 * s1y - b2 * s2y)) as sse, n * syy as sst
  from (select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1,
               (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from m))"""
