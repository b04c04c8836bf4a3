"""Profiles, key figures and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelift.operators import correlation, frequency, kpi, profiling
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.shared import GAPPED, gapped

LINE = ["l_quantity", "l_extendedprice", "l_discount"]
MIXED = "mixed as (select o_orderkey, price, priority, o_orderstatus, o_orderdate, case when o_orderkey % 5 = 0 then '' else o_orderstatus end as note from gapped)"


def mixed(t: Tables):
    rows = gapped(t)
    return rows.select("o_orderkey", "price", "priority", "o_orderstatus", "o_orderdate", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("note"))


def _per_column(template: str, columns, tail: str = "lineitem") -> str:
    return " union all ".join(f"select '{c}' as variable, {template.replace('@', c)} from {tail}" for c in columns)


BASIC = ", ".join([rd("avg(@)", 6, "mean"), rd("stddev_samp(@)", 6, "std"), rd("min(@)", 6, "min"), rd("max(@)", 6, "max")])


@query("describe_basic", _per_column(BASIC, LINE))
def _describe_basic(t: Tables):
    return rounded(profiling.describe_basic(t.lineitem, LINE), 6)


QUART = ", ".join(rd(f"quantile_cont(@, {q})", 6, n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))


@query("describe_full", _per_column(f"count(@) as count, {BASIC}, {QUART}", LINE))
def _describe_full(t: Tables):
    return rounded(profiling.describe_full(t.lineitem, LINE), 6)


@query("outliers_p99", " union all ".join(f"""
select '{c}' as variable, {rd('any_value(q)', 6, 'threshold')}, count(*) filter ({c} > q) as outlier_count, {rd(f'count(*) filter ({c} > q) * 100.0 / count(*)', 6, 'outlier_percent')}
from lineitem, (select quantile_cont({c}, 0.99) as q from lineitem)""" for c in LINE))
def _outliers_p99(t: Tables):
    return rounded(profiling.outliers_above_quantile(t.lineitem, LINE), 6)


def _iqr(c: str, table: str) -> str:
    return f"(select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table})"


@query("outliers_iqr", " union all ".join(f"""
select '{c}' as variable, {rd('any_value(q1 - 1.5 * (q3 - q1))', 6, 'lower_bound')}, {rd('any_value(q3 + 1.5 * (q3 - q1))', 6, 'upper_bound')},
  count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count,
  {rd(f'count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*)', 6, 'outlier_percent')}
from lineitem, {_iqr(c, 'lineitem')}""" for c in LINE))
def _outliers_iqr(t: Tables):
    return rounded(profiling.outliers_iqr(t.lineitem, LINE), 6)


def _numeric_sql(c: str, table: str) -> str:
    d = f"({c} - mu)"
    return f"""
select '{c}' as variable, count(*) as count, count({c}) as non_null_count, count(*) - count({c}) as null_count,
  {rd(f'(count(*) - count({c})) * 100.0 / count(*)', 4, 'null_percent')}, {rd(f'avg({c})', 4, 'mean')}, {rd('any_value(med)', 4, 'median')},
  {rd(f'stddev_samp({c})', 4, 'std')}, {rd(f'var_samp({c})', 0, 'variance')}, {rd(f'min({c})', 4, 'min')}, {rd(f'max({c})', 4, 'max')},
  {rd(f'max({c}) - min({c})', 4, 'range')}, {rd('any_value(q1)', 4, 'q25')}, {rd('any_value(q3)', 4, 'q75')}, {rd('any_value(q3 - q1)', 4, 'iqr')},
  {rd(f'avg({d} ** 3) / (avg({d} ** 2) ** 1.5)', 4, 'skewness')}, {rd(f'avg({d} ** 4) / (avg({d} ** 2) ** 2) - 3', 4, 'kurtosis')},
  count(distinct {c}) as unique_count, count(*) filter ({c} = 0) as zero_count, count(*) filter ({c} < 0) as negative_count, count(*) filter ({c} > 0) as positive_count,
  count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count,
  {rd(f'count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*)', 4, 'outlier_percent')}
from {table}, (select avg({c}) as mu, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from {table})"""


@query("profile_numeric", f"with {GAPPED} {_numeric_sql('price', 'gapped')} union all {_numeric_sql('o_orderkey', 'gapped')}")
def _profile_numeric(t: Tables):
    out = profiling.profile_numeric(gapped(t), ["price", "o_orderkey"])
    return rounded(rounded(out, 0, "variance"), 4, *[c for c, k in out.dtypes if k == "double" and c != "variance"])


def _categorical_sql(c: str) -> str:
    return f"""
select '{c}' as variable, count(*) as count, count({c}) as non_null_count, count(*) - count({c}) as null_count,
  {rd(f'(count(*) - count({c})) * 100.0 / count(*)', 6, 'null_percent')}, {rd(f'avg(length({c}))', 6, 'avg_length')},
  min(length({c})) as min_length, max(length({c})) as max_length, count(*) filter ({c} = '') as empty_count, count(distinct {c}) as unique_count,
  (select {c} from mixed where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as mode,
  (select count(*) from mixed where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as mode_count from mixed"""


@query("profile_categorical", f"with {GAPPED}, {MIXED} {_categorical_sql('priority')} union all {_categorical_sql('o_orderstatus')} union all {_categorical_sql('note')}")
def _profile_categorical(t: Tables):
    return rounded(profiling.profile_categorical(mixed(t), ["priority", "o_orderstatus", "note"]), 6)


@query("top_values", " union all ".join(f"""
select '{c}' as variable, value, n, cast(rank as int) as rank from (
  select cast({c} as varchar) as value, count(*) as n, row_number() over (order by count(*) desc, cast({c} as varchar)) as rank from part group by 1) where rank <= 10"""
  for c in ("p_brand", "p_type", "p_size")))
def _top_values(t: Tables):
    return frequency.top_values(t.part, ["p_brand", "p_type", "p_size"])


@query("distinct_values", " union all ".join(f"""
select '{c}' as variable, cast(p as int) as position, value from (
  select value, row_number() over (order by value) as p from (select distinct cast({c} as varchar) as value from part)) where p <= 20"""
  for c in ("p_brand", "p_type")))
def _distinct_values(t: Tables):
    return frequency.distinct_sample(t.part, ["p_brand", "p_type"])


@query("profile_datetime", """
select 'o_orderdate' as variable, count(*) as count, count(o_orderdate) as non_null_count, count(*) - count(o_orderdate) as null_count, min(o_orderdate) as min_date,
  max(o_orderdate) as max_date, cast(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) as bigint) as range_days, count(distinct o_orderdate) as unique_dates from orders""")
def _profile_datetime(t: Tables):
    return profiling.profile_datetime(t.orders, ["o_orderdate"])


@query("profile_dataset", f"""
with {GAPPED}, d as (select o_orderstatus, price, priority, o_orderdate from gapped union all select o_orderstatus, price, priority, o_orderdate from gapped where o_orderkey % 4 = 0),
g as (select count(*) as n from d group by o_orderstatus, price, priority, o_orderdate),
c as (select count(*) as row_count, 4 as w, count(*) * 4 - count(o_orderstatus) - count(price) - count(priority) - count(o_orderdate) as missing from d)
select row_count, cast(4 as bigint) as column_count, row_count * 4 as total_cells, missing as total_missing, {rd('(row_count * 4 - missing) * 100.0 / (row_count * 4)', 6, 'completeness')},
  cast(2 as bigint) as columns_with_missing, cast(1 as bigint) as numeric_columns, cast(2 as bigint) as categorical_columns, cast(1 as bigint) as datetime_columns,
  (select cast(sum(n - 1) as bigint) from g) as duplicate_rows, {rd('(select sum(n - 1) from g) * 100.0 / row_count', 6, 'duplicate_percent')} from c""")
def _profile_dataset(t: Tables):
    rows = gapped(t)
    names = ["o_orderstatus", "price", "priority", "o_orderdate"]
    return rounded(profiling.profile_dataset(rows.select(*names).unionByName(rows.filter("o_orderkey % 4 = 0").select(*names))), 6)


@query("duplicate_rows", f"""
with g as (select count(*) as n from lineitem group by l_quantity, l_discount, l_returnflag)
select cast(sum(n) as bigint) as row_count, cast(sum(n - 1) as bigint) as duplicate_rows, {rd('sum(n - 1) * 100.0 / sum(n)', 6, 'duplicate_percent')} from g""")
def _duplicate_rows(t: Tables):
    return rounded(profiling.duplicate_rows(t.lineitem.select("l_quantity", "l_discount", "l_returnflag")), 6)


@query("date_coverage", "select min(o_orderdate) as start_date, max(o_orderdate) as end_date, count(distinct o_orderdate) as total_periods from orders")
def _date_coverage(t: Tables):
    return profiling.date_coverage(t.orders, "o_orderdate")


@query("detect_types", """
with x as (select cast(o_orderdate as varchar) as order_date, case when o_orderkey % 9 = 0 then 'n/a' else cast(o_totalprice as varchar) end as price,
                  case when o_orderkey % 2 = 0 then 'n/a' else cast(o_totalprice as varchar) end as half, cast(o_custkey as varchar) as customer, o_orderpriority as day_text from orders)
select 'order_date' as variable, case when count(try_cast(order_date as timestamp)) > 0.7 * count(order_date) and min(year(try_cast(order_date as timestamp))) < max(year(try_cast(order_date as timestamp))) then 'datetime' else 'categorical' end as detected_type from x
union all select 'price', case when count(try_cast(price as double)) > 0.7 * count(price) then case when count(*) filter (try_cast(price as double) % 1 <> 0) = 0 then 'integer' else 'numeric' end else 'categorical' end from x
union all select 'half', case when count(try_cast(half as double)) > 0.7 * count(half) then 'numeric' else 'categorical' end from x
union all select 'customer', case when count(try_cast(customer as double)) > 0.7 * count(customer) then 'integer' else 'categorical' end from x
union all select 'day_text', case when count(try_cast(day_text as double)) > 0.7 * count(day_text) then 'integer' else 'categorical' end from x""")
def _detect_types(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_orderdate").cast("string").alias("order_date"),
        F.when(k % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 2 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("half"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("day_text"),
    )
    return profiling.detect_types(rows)


@query("kpi_totals", f"select {rd('sum(l_quantity) + sum(l_tax)', 4, 'total_value')}, {rd('sum(l_extendedprice)', 2, 'total_target')}, {rd('sum(l_extendedprice) / (sum(l_quantity) + sum(l_tax)) * 100', 4, 'roi_percent')} from lineitem")
def _kpi_totals(t: Tables):
    out = kpi.kpi_totals(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return rounded(rounded(out, 2, "total_target"), 4, "total_value", "roi_percent")


@query("kpi_features", "select feature, " + ", ".join([rd("v", 4, "total_value"), rd("c", 6, "correlation"), rd("case when c > 0 then c * t else 0 end", 2, "target_driven"), rd("case when v > 0 and c > 0 then c * t / v * 100 else 0 end", 4, "roi_percent"), rd("case when v > 0 then t / v else 0 end", 4, "efficiency")])
       + " from (" + " union all ".join(f"select '{c}' as feature, sum({c}) as v, corr({c}, l_extendedprice) as c, sum(l_extendedprice) as t from lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def _kpi_features(t: Tables):
    out = kpi.kpi_features(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rounded(rounded(rounded(out, 6, "correlation"), 2, "target_driven"), 4, "total_value", "roi_percent", "efficiency")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "net", "gap"]
CORR_ROWS = "c as (select l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) as net, case when l_orderkey % 7 <> 0 then l_tax end as gap from lineitem)"


def corr_rows(t: Tables):
    return t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("gap"),
    )


CORR_TIDY = "tidy as (" + " union all ".join(
    f"select {i} as i, {j} as j, '{a}' as var_i, '{b}' as var_j, corr({a}, {b}) as corr, count(*) filter ({a} is not null and {b} is not null) as pairs from c"
    for i, a in enumerate(CORR) for j, b in enumerate(CORR)) + ")"


@query("correlation_matrix", f"with {CORR_ROWS}, {CORR_TIDY} select i, j, var_i, var_j, {rd('corr', 6, 'corr')}, pairs from tidy")
def _correlation_matrix(t: Tables):
    return rounded(correlation.correlation_matrix(corr_rows(t), CORR), 6)


@query("correlation_summary", f"with {CORR_ROWS}, {CORR_TIDY} select {rd('avg(abs(corr))', 6, 'mean_abs_corr')}, {rd('max(abs(corr))', 6, 'max_abs_corr')}, {rd('min(abs(corr))', 6, 'min_abs_corr')} from tidy")
def _correlation_summary(t: Tables):
    return rounded(correlation.correlation_summary(correlation.correlation_matrix(corr_rows(t), CORR)), 6)


@query("correlation_histogram", f"""
with {CORR_ROWS}, {CORR_TIDY}, b as (select least(cast(floor((corr + 1) / 0.04) as int), 49) as bin from tidy where i < j)
select bin, {rd('bin * 0.04::double - 1', 6, 'low')}, {rd('bin * 0.04::double - 0.96', 6, 'high')}, count(*) as n from b group by bin""")
def _correlation_histogram(t: Tables):
    return rounded(correlation.correlation_histogram(correlation.correlation_matrix(corr_rows(t), CORR)), 6)


@query("importance_correlation", f"with {CORR_ROWS}, {CORR_TIDY} select var_i as feature, {rd('corr', 6, 'corr')}, cast(row_number() over (order by abs(corr) desc, var_i) as int) as importance_rank from tidy where var_j = 'l_extendedprice' and var_i <> 'l_extendedprice'")
def _importance_correlation(t: Tables):
    from panelift.operators.linear import ranked

    matrix = correlation.correlation_matrix(corr_rows(t), CORR)
    table = correlation.correlation_with_target(matrix, "l_extendedprice").withColumnRenamed("variable", "feature")
    return rounded(ranked(table, F.col("corr"), "feature"), 6)
