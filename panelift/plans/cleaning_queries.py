"""Filters, missing data, experiment design."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelift.functions import columns as col
from panelift.operators import design, filters, missing
from panelift.operators.ordered import row_range, split_by_time
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.shared import CUTOFF, GAPPED, GEO, TREATED, gapped, geo_orders

NATIONS = ", ".join(f"'{n}'" for n in TREATED)
ORDER = ["o_orderdate", "o_orderkey"]


@query("filter_date_range", "select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '1996-03-01' and timestamp '1997-02-28'")
def _filter_date_range(t: Tables):
    return filters.date_range(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-03-01", "1997-02-28")


@query("filter_numeric_range", """
select o_orderkey, case when o_orderkey % 9 = 0 then 'n/a' else cast(o_totalprice as varchar) end as price from orders
where try_cast(case when o_orderkey % 9 = 0 then 'n/a' else cast(o_totalprice as varchar) end as double) between 1000 and 99999.5""")
def _filter_numeric_range(t: Tables):
    text = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return filters.numeric_range(text, "price", 1000, 99999.5)


@query("filter_values", "select p_partkey, p_size from part where cast(p_size as varchar) in ('1', '7', '49')")
def _filter_values(t: Tables):
    return filters.keep_values(t.part.select("p_partkey", "p_size"), "p_size", ["1", "7", "49"])


@query("filter_row_range", """
select o_orderkey, o_orderdate from (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as r from orders) where r between 1000 and 8999""")
def _filter_row_range(t: Tables):
    return row_range(t.orders.select("o_orderkey", "o_orderdate"), ORDER, 1000, 8999)


@query("numeric_columns", "select p_partkey, p_size, p_retailprice from part")
def _numeric_columns(t: Tables):
    return col.select_numeric(t.part, "p_retailprice")


@query("drop_constant_columns", "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem")
def _drop_constant_columns(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit(1.0).alias("flat"))
    return filters.drop_constant_columns(rows)


FLAGGED = f"flagged as (select *, case when city in ({NATIONS}) then 1 else 0 end as treated, case when o_orderdate > timestamp '{CUTOFF}' then 1 else 0 end as post from geo)"


def did_orders(t: Tables):
    return design.post_by_date(design.treated_by_location(geo_orders(t), "city", TREATED), "o_orderdate", CUTOFF)


@query("flag_check", f"""
with {GEO}, {FLAGGED}, f as (select 'treated' as flag, treated as v from flagged union all select 'post', post from flagged
  union all select 'broken', case when o_orderkey % 10 = 0 then null when o_orderkey % 10 = 1 then 2 else 1 end from flagged)
select flag, count(*) filter (v = 1) as ones, count(*) filter (v = 0) as zeros, count(*) filter (v is null or v not in (0, 1)) as invalid from f group by flag""")
def _flag_check(t: Tables):
    broken = F.when(F.col("o_orderkey") % 10 == 0, None).when(F.col("o_orderkey") % 10 == 1, 2).otherwise(1)
    return filters.flag_counts(did_orders(t).withColumn("broken", broken), ["treated", "post", "broken"])


@query("validate_training", """
select 'minimum_rows' as check_name, count(*) >= 5 as passed from orders
union all select 'required_columns', true union all select 'model_columns', false""")
def _validate_training(t: Tables):
    return filters.validation_report(t.orders, "o_totalprice", ["o_custkey"], "did")


def _missing(name: str, price: str, priority: str, method: str, ordered: bool = False, columns=("price", "priority")):
    """Register one missing-data method over the gapped orders."""

    def run(t: Tables):
        rows = gapped(t)
        if ordered:
            done = missing.handle_missing(rows, method, list(columns), ORDER, ["o_orderstatus"])
        else:
            done = missing.handle_missing(rows, method, list(columns))
        return rounded(done.select("o_orderkey", "price", "priority"), 4)

    w = "partition by o_orderstatus order by o_orderdate, o_orderkey"
    query(name, f"with {GAPPED}, {ORDERED} select o_orderkey, {rd(price, 4, 'price')}, {priority} as priority from g".replace("@w", w))(run)


ORDERED = "g as (select * from gapped)"
MODE = "(select priority from gapped where priority is not null group by priority order by count(*) desc, priority limit 1)"
PRICE_MODE = "(select price from gapped where price is not null group by price order by count(*) desc, price limit 1)"


@query("missing_listwise", f"with {GAPPED} select o_orderkey, price, priority from gapped where price is not null and priority is not null")
def _missing_listwise(t: Tables):
    return missing.handle_missing(gapped(t), "listwise", ["price", "priority"]).select("o_orderkey", "price", "priority")


_missing("missing_zero", "coalesce(price, 0)", "coalesce(priority, '0')", "zero")
_missing("missing_mean", "coalesce(price, (select avg(price) from gapped))", f"coalesce(priority, {MODE})", "mean")
_missing("missing_median", "coalesce(price, (select quantile_cont(price, 0.5) from gapped))", f"coalesce(priority, {MODE})", "median")
_missing("missing_mode", f"coalesce(price, {PRICE_MODE})", f"coalesce(priority, {MODE})", "mode")
_missing(
    "missing_ffill",
    "coalesce(last_value(price ignore nulls) over (@w rows between unbounded preceding and current row), 0)",
    "coalesce(last_value(priority ignore nulls) over (@w rows between unbounded preceding and current row), '0')",
    "ffill",
    True,
)
_missing(
    "missing_bfill",
    "coalesce(first_value(price ignore nulls) over (@w rows between current row and unbounded following), 0)",
    "coalesce(first_value(priority ignore nulls) over (@w rows between current row and unbounded following), '0')",
    "bfill",
    True,
)


@query("missing_interpolate", f"""
with {GAPPED}, n as (select *, row_number() over w as rn from gapped window w as (partition by o_orderstatus order by o_orderdate, o_orderkey)),
s as (select *, last_value(price ignore nulls) over b as pv, last_value(case when price is not null then rn end ignore nulls) over b as pr,
             first_value(price ignore nulls) over a as nv, first_value(case when price is not null then rn end ignore nulls) over a as nr
      from n window b as (partition by o_orderstatus order by rn rows between unbounded preceding and current row),
                    a as (partition by o_orderstatus order by rn rows between current row and unbounded following)),
i as (select o_orderkey, priority, coalesce(price, pv + (nv - pv) * (rn - pr) / (nr - pr), pv) as price from s)
select o_orderkey, {rd('coalesce(price, (select avg(price) from i))', 4, 'price')}, coalesce(priority, {MODE}) as priority from i""")
def _missing_interpolate(t: Tables):
    done = missing.handle_missing(gapped(t), "interpolate", ["price", "priority"], ORDER, ["o_orderstatus"])
    return rounded(done.select("o_orderkey", "price", "priority"), 4)


@query("missing_summary", f"""
with {GAPPED}, c as (select count(*) as n, count(*) - count(price) as p, count(*) - count(priority) as q from gapped),
u as (select 'price' as variable, p as m, n, p + q as t from c union all select 'priority', q, n, p + q from c)
select variable, m as missing_count, {rd('m * 100.0 / n', 6, 'missing_percent')}, t as total_missing, {rd('100 - t * 100.0 / (2 * n)', 6, 'completeness')} from u""")
def _missing_summary(t: Tables):
    return rounded(missing.missing_summary(gapped(t), ["price", "priority"]), 6)


@query("treated_location", f"with {GEO}, {FLAGGED} select o_orderkey, city, treated from flagged")
def _treated_location(t: Tables):
    return design.treated_by_location(geo_orders(t), "city", TREATED).select("o_orderkey", "city", "treated")


@query("post_date", f"select o_orderkey, case when o_orderkey % 13 <> 0 and o_orderdate > timestamp '{CUTOFF}' then 1 else 0 end as post from orders")
def _post_date(t: Tables):
    rows = t.orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")))
    return design.post_by_date(rows, "o_orderdate", CUTOFF).select("o_orderkey", "post")


@query("post_period", "select o_orderkey, case when year(o_orderdate) > 1998 then 1 else 0 end as post from orders")
def _post_period(t: Tables):
    return design.post_by_period(t.orders.withColumn("year", F.year("o_orderdate")), "year", 1998).select("o_orderkey", "post")


@query("treated_quantile", f"with {GAPPED}, q as (select quantile_cont(price, 0.75) as cut from gapped) select o_orderkey, case when price > cut then 1 else 0 end as treated from gapped, q")
def _treated_quantile(t: Tables):
    return design.treated_by_quantile(gapped(t), "price", 0.75).select("o_orderkey", "treated")


@query("did_prepare", f"with {GEO}, {FLAGGED} select o_orderkey, treated, post from flagged")
def _did_prepare(t: Tables):
    return design.prepare_did(geo_orders(t), "city", TREATED, "o_orderdate", CUTOFF).select("o_orderkey", "treated", "post")


@query("sc_prepare", f"""
with {GEO} select count(*) filter (city = 'NATION_3') as treated_rows, count(*) filter (city <> 'NATION_3') as control_rows,
  count(distinct city) filter (city <> 'NATION_3') as control_units from geo""")
def _sc_prepare(t: Tables):
    return design.prepare_synthetic_control(geo_orders(t), "city", "NATION_3")[1]


@query("did_crosstab", f"""
with {GEO}, {FLAGGED}
select coalesce(cast(treated as varchar), 'All') as treated, coalesce(cast(post as varchar), 'All') as post, count(*) as n, count(*) < 5 as low_cell
from flagged group by cube (treated, post)""")
def _did_crosstab(t: Tables):
    return design.crosstab(did_orders(t))


@query("did_balance", f"""
with {GEO}, {FLAGGED}, c as (select count(*) as n from flagged group by treated, post)
select min(n) as min_cell, max(n) as max_cell, {rd('min(n) * 1.0 / max(n)', 6, 'balance_ratio')}, min(n) * 1.0 / max(n) > 0.2 as balanced from c""")
def _did_balance(t: Tables):
    return rounded(design.did_balance(did_orders(t)), 6)


@query("did_cell_means", f"""
with {GEO}, {FLAGGED} select post, {rd('avg(o_totalprice) filter (treated = 0)', 4, 'control_mean')}, {rd('avg(o_totalprice) filter (treated = 1)', 4, 'treated_mean')}
from flagged group by post""")
def _did_cell_means(t: Tables):
    return rounded(design.cell_means(did_orders(t), "o_totalprice"), 4)


@query("time_split", """
with n as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as r, count(*) over () as n from orders)
select o_orderkey, case when r < floor(0.8 * n) then 1 else 0 end as is_train from n""")
def _time_split(t: Tables):
    return split_by_time(t.orders.select("o_orderkey", "o_orderdate"), ORDER, 0.2).select("o_orderkey", "is_train")
