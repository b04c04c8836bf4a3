"""Queries whose input holds the awkward cases: gaps, NaN, empty cells, huge integers, hot keys, wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelift.functions.columns import recode_values
from panelift.operators import boosting, causal, collinearity, correlation, design, frequency, gram, linear, missing, ordered, profiling, report, series, trees, validation
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.operators.panel import brand_long
from panelift.plans.diagnostic_queries import COL3, PAIRS, _vif_sql, corr_rows, pairs_of, vifs
from panelift.plans.model_queries import DID, did_orders, people
from panelift.plans.shared import ADS, HOURLY, ads, hourly, two_feature_ols
from panelift.session import scratch_path
from panelift.sources import reports, tables

# -- matching where outcomes are missing

GAP_PEOPLE = """sums as (select o_custkey, sum(o_totalprice) as spend from orders group by o_custkey),
people as (select c_custkey, c_acctbal, case when c_mktsegment = 'BUILDING' then 1 else 0 end as treated, case when c_custkey % 3 <> 0 then coalesce(spend, 0) end as spend
  from customer left join sums on o_custkey = c_custkey)"""


@query("nearest_match_gaps", f"""
with {GAP_PEOPLE}, near as (
  select *, max(case when treated = 0 then struct_pack(s := c_acctbal, k := c_custkey) end) over (order by c_acctbal, c_custkey rows between unbounded preceding and current row) as b,
    min(case when treated = 0 then struct_pack(s := c_acctbal, k := c_custkey) end) over (order by c_acctbal, c_custkey rows between current row and unbounded following) as a from people),
m as (select *, case when b is not null and (a is null or c_acctbal - b.s <= a.s - c_acctbal) then b else a end as hit from near where treated = 1)
select m.c_custkey, hit.k as match_key, {rd('m.spend', 2, 'spend')}, {rd('p.spend', 2, 'match_spend')} from m left join people p on p.c_custkey = hit.k""")
def _nearest_match_gaps(t: Tables):
    rows = people(t).withColumn("spend", F.when(F.col("c_custkey") % 3 != 0, F.col("spend")))
    out = causal.nearest_match(rows, "c_acctbal", "c_custkey", ["spend"])
    return rounded(out.select("c_custkey", "match_key", "spend", "match_spend"), 2)


# -- correlation with NaN and NULL, and over many columns

NAN_ROWS = "c as (select l_quantity as a, case when l_orderkey % 5 <> 0 then l_extendedprice end as b, case when l_orderkey % 7 <> 0 then l_discount end as c, 3.0 as d from lineitem)"


@query("correlation_nan", f"with {NAN_ROWS} " + " union all ".join(
    f"select '{a}' as var_i, '{b}' as var_j, {'null::double' if 'd' in (a, b) else rd(f'corr({a}, {b})', 6)} as corr, count(*) filter ({a} is not null and {b} is not null) as pairs from c"
    for a in "abcd" for b in "abcd"))
def _correlation_nan(t: Tables):
    rows = t.lineitem.select(
        F.col("l_quantity").alias("a"), F.when(F.col("l_orderkey") % 5 == 0, float("nan")).otherwise(F.col("l_extendedprice")).alias("b"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("c"), F.lit(3.0).alias("d"),
    )
    return rounded(correlation.correlation_matrix(rows, list("abcd")).select("var_i", "var_j", "corr", "pairs"), 6)


WIDE = [f"w{i}" for i in range(18)]


def _wide_sql(i: int) -> str:
    return f"case when l_orderkey % {i + 11} <> 0 then sin(l_quantity * {i + 1}) + l_discount * {i} + l_extendedprice / {10000 * (i + 1)} end"


WIDE_ROWS = "wide as (select " + ", ".join(f"{_wide_sql(i)} as {c}" for i, c in enumerate(WIDE)) + " from lineitem)"


def wide_rows(t: Tables):
    return t.lineitem.select(*[F.expr(_wide_sql(i)).alias(c) for i, c in enumerate(WIDE)])


@query("correlation_wide", f"with {WIDE_ROWS} " + " union all ".join(
    f"select '{a}' as var_i, '{b}' as var_j, {rd(f'corr({a}, {b})', 6, 'corr')}, count(*) filter ({a} is not null and {b} is not null) as pairs from wide" for a in WIDE for b in WIDE))
def _correlation_wide(t: Tables):
    return rounded(correlation.correlation_matrix(wide_rows(t), WIDE).select("var_i", "var_j", "corr", "pairs"), 6)


WIDE_OK = " and ".join(f"{c} is not null" for c in WIDE)


@query("moments_wide", f"with {WIDE_ROWS}, ok as (select * from wide where {WIDE_OK}) " + " union all ".join(
    f"select '{a}' as var_i, '{b}' as var_j, count(*) as n, {rd(f'covar_pop({a}, {b})', 6, 'covariance')} from ok" for a in WIDE for b in WIDE))
def _moments_wide(t: Tables):
    frame = gram.moments_frame(wide_rows(t), WIDE)
    names = F.array(*[F.lit(c) for c in WIDE])
    cells = frame.select("n", F.posexplode("cross").alias("at", "x"))
    k = len(WIDE)
    cell = lambda i: F.element_at(names, (i + 1).cast("int"))
    out = cells.select(
        cell(F.floor(F.col("at") / k)).alias("var_i"), cell(F.col("at") % k).alias("var_j"), F.col("n").cast("long").alias("n"), (F.col("x") / F.col("n")).alias("covariance")
    )
    return rounded(out, 6)


# -- repair and recode

DATED = """dated as (select o_orderkey, case when o_orderkey % 6 <> 0 then cast(o_orderdate as date) end as day, case when o_orderkey % 4 <> 0 then o_totalprice > 100000 end as big,
  case when o_orderkey % 5 <> 0 then case when o_orderkey % 3 = 0 then 9007199254740993 else 9007199254740992 end end as id from orders)"""


def dated(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(key % 6 != 0, F.to_date("o_orderdate")).alias("day"), F.when(key % 4 != 0, F.col("o_totalprice") > 100000).alias("big"),
        F.when(key % 5 != 0, F.when(key % 3 == 0, F.lit(9007199254740993)).otherwise(F.lit(9007199254740992))).alias("id"),
    )


def _mode(c: str, order: str = "") -> str:
    return f"(select {c} from dated where {c} is not null group by {c} order by count(*) desc, {order or c} limit 1)"


@query("missing_mode_kinds", f"with {DATED} select o_orderkey, coalesce(day, {_mode('day')}) as day, coalesce(big, {_mode('big')}) as big, coalesce(id, {_mode('id')}) as id from dated")
def _missing_mode_kinds(t: Tables):
    return missing.handle_missing(dated(t), "mode", ["day", "big", "id"])


@query("missing_mean_kinds", f"with {DATED} select o_orderkey, coalesce(day, {_mode('day')}) as day, coalesce(big, {_mode('big')}) as big from dated")
def _missing_mean_kinds(t: Tables):
    return missing.handle_missing(dated(t).drop("id"), "mean", ["day", "big"])


@query("unique_large_integers", f"with {DATED} select count(distinct id) as unique_count, count(id) as non_null_count from dated")
def _unique_large_integers(t: Tables):
    return profiling.profile_numeric(dated(t), ["id"]).select("unique_count", "non_null_count")


@query("recode_to_missing", "select nullif(c_mktsegment, 'BUILDING') as segment, count(*) as n from customer group by 1")
def _recode_to_missing(t: Tables):
    # many entries that never occur must not change what the one that does occur means
    mapping = {f"never {i}": "x" for i in range(300)} | {"BUILDING": None}
    recoded = recode_values(t.customer.select(F.col("c_mktsegment").alias("segment")), "segment", mapping)
    return recoded.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("crosstab_empty", """
with f as (select case when o_orderkey % 3 = 0 then 1 else 0 end as treated, case when o_orderkey % 3 <> 0 and o_totalprice > 150000 then 1 else 0 end as post from orders),
g as (select t.treated, p.post, count(f.treated) as n from (select distinct treated from f) t cross join (select distinct post from f) p
  left join f on f.treated = t.treated and f.post = p.post group by all)
select coalesce(cast(treated as varchar), 'All') as treated, coalesce(cast(post as varchar), 'All') as post, cast(sum(n) as bigint) as n, sum(n) < 5 as low_cell from g group by cube (treated, post)""")
def _crosstab_empty(t: Tables):
    third = F.col("o_orderkey") % 3 == 0
    flags = t.orders.select(third.cast("int").alias("treated"), (~third & (F.col("o_totalprice") > 150000)).cast("int").alias("post"))
    return design.crosstab(flags)


# -- series

SHORT = f"""{HOURLY}, few as (select * from hourly union all select 'brief', hour, value, n from (select *, row_number() over (order by hour) as r from hourly where event_type = (select min(event_type) from hourly)) where r <= 10)"""


@query("forecast_metrics_seasonal", f"""
with {SHORT}, o as (select *, row_number() over (partition by event_type order by hour) as rn, floor(0.8 * count(*) over (partition by event_type)) as cut from few),
ends as (select event_type, any_value(cut) as m, max(value) filter (rn = cut) as last, (max(value) filter (rn = cut) - max(value) filter (rn = 1)) / (any_value(cut) - 1) as slope from o group by event_type),
s as (select o.event_type, o.value as y, coalesce(b.value, last + (o.rn - o.cut) * slope) as p from o join ends using (event_type)
  left join o b on b.event_type = o.event_type and b.rn = o.cut - 12 + 1 + (o.rn - o.cut - 1) % 12 and b.rn >= 1 where o.rn > o.cut)
select event_type, count(*) as test_size, {rd('avg(abs(y - p))', 4, 'mae')}, {rd('avg((y - p) ** 2)', 4, 'mse')}, {rd('sqrt(avg((y - p) ** 2))', 4, 'rmse')},
  case when min(y) > 0 then {rd('avg(abs((y - p) / y)) * 100', 4)} end as mape from s group by event_type""")
def _forecast_metrics_seasonal(t: Tables):
    rows = hourly(t)
    first = rows.agg(F.min("event_type").alias("e"))
    brief = rows.join(F.broadcast(first), F.col("event_type") == F.col("e")).orderBy("hour").limit(10).select(F.lit("brief").alias("event_type"), "hour", "value", "n")
    return rounded(series.holdout_metrics(rows.unionByName(brief).drop("n"), "hour", "value", ["event_type"], season=12), 4)


@query("infer_step_repeated", """
with r as (select event_type, cast(floor(epoch(ts) / 86400) as bigint) as day from events), d as (select event_type, day - lag(day) over (partition by event_type order by day) as step from r),
c as (select event_type, step, count(*) as n from d where step is not null group by all)
select event_type, step, n as step_count from c qualify row_number() over (partition by event_type order by n desc, step) = 1""")
def _infer_step_repeated(t: Tables):
    days = t.events.select("event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day"))
    return ordered.modal_step(days, "day", ["event_type"])


# -- small tables

@query("aligned_metrics", f"""
with a as (select o_totalprice as y, row_number() over (order by o_orderkey) as i from orders), p as (select l_extendedprice * 2 as p, row_number() over (order by l_orderkey, l_linenumber, l_partkey) as i from lineitem where l_linenumber = 1)
select count(*) as observations, {rd('avg(abs(y - p))', 4, 'mae')}, {rd('sqrt(avg((y - p) ** 2))', 4, 'rmse')} from a join p using (i)""")
def _aligned_metrics(t: Tables):
    actual = t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"))
    predicted = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * 2).alias("p"))
    both = ordered.align_by_position(actual, predicted, ["o_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(linear.fit_metrics(both, "y", "p", 1).select("observations", "mae", "rmse"), 4)


@query("top_pairs", f"with {PAIRS} select variable_1, variable_2, {rd('abs_correlation', 6, 'abs_correlation')} from pairs order by pairs.abs_correlation desc, variable_1, variable_2 limit 2")
def _top_pairs(t: Tables):
    return rounded(collinearity.top_pairs(pairs_of(t)[1], 2).select("variable_1", "variable_2", "abs_correlation"), 6)


@query("top_vif", f"with {_vif_sql()} select variable, {rd('vif', 6, 'vif')}, vif > 10 as high from vif order by vif.vif desc, variable limit 2")
def _top_vif(t: Tables):
    return rounded(collinearity.top_vif(vifs(t), 2), 6)


@query("vif_constant_gaps", f"with {_vif_sql()} select variable, {rd('vif', 6, 'vif')}, vif > 10 as high from vif")
def _vif_constant_gaps(t: Tables):
    # a constant column with gaps, and an empty one, cost no rows
    rows = corr_rows(t).withColumns({"flat": F.when(F.col("l_quantity") > 10, 7.0), "empty": F.lit(None).cast("double")})
    return rounded(collinearity.vif(rows, [*COL3, "flat", "empty"]), 6)


# -- a tree that SQL can grow

STUMP = """rows as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as y, case when l_orderkey % 6 <> 0 then l_linenumber end as x from lineitem),
tall as (select count(*) as n, sum(y) as s from rows),
cuts as (select v, sum(n) over (order by v) as n, sum(s) over (order by v) as s from (select x as v, count(*) as n, sum(y) as s from rows where x is not null group by x)),
best as (select v, c.s / c.n as low, (tall.s - c.s) / (tall.n - c.n) as high from cuts c, tall where tall.n > c.n order by c.s * c.s / c.n + (tall.s - c.s) ** 2 / (tall.n - c.n) desc limit 1)"""


@query("gbt_missing", f"with {STUMP} select l_orderkey, l_linenumber, l_partkey, {rd('case when x <= v then low else high end', 4, 'prediction')} from rows, best")
def _gbt_missing(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber")).alias("x"))
    model = trees.fit_gbt(rows, "y", ["x"], trees=1, rate=1.0, depth=1)
    return rounded(trees.predict_trees(rows, model, ["x"]).select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 4)


FOREST_STUMP = """rows as (select l_orderkey, l_extendedprice as y, case when l_orderkey % 6 <> 0 then l_linenumber end as x,
  case when l_orderkey % 5 = 0 then 'test' else 'train' end as split from lineitem),
tall as (select count(*) as n, sum(y) as s from rows where split = 'train'),
cuts as (select v, sum(n) over (order by v) as n, sum(s) over (order by v) as s
  from (select x as v, count(*) as n, sum(y) as s from rows where split = 'train' and x is not null group by x)),
best as (select v, c.s / c.n as low, (tall.s - c.s) / (tall.n - c.n) as high from cuts c, tall where tall.n > c.n order by c.s * c.s / c.n + (tall.s - c.s) ** 2 / (tall.n - c.n) desc limit 1),
parts as (select split, count(*) as n, avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse, var_pop(y) as v
  from (select split, y, case when x <= v then low else high end as p from rows, best) group by split),
m as (select max(case when split = 'train' then n end)::double as n, max(case when split = 'train' then mae end) as train_mae,
  max(case when split = 'test' then mae end) as test_mae, max(case when split = 'train' then mse end) as train_mse,
  max(case when split = 'test' then mse end) as test_mse, 1 - max(case when split = 'train' then mse end) / max(case when split = 'train' then v end) as r2tr,
  1 - max(case when split = 'test' then mse end) / max(case when split = 'test' then v end) as r2te from parts)"""


@query("baseline_forest_stump", f"""with {FOREST_STUMP}
select 'random_forest' as model, {rd('r2tr', 4, 'train_r2')}, {rd('r2te', 4, 'test_r2')},
  {rd('case when n > 2 then 1 - (1 - r2tr) * (n - 1) / (n - 2) end', 4, 'train_adj_r2')}, {rd('train_mae', 4, 'train_mae')},
  {rd('test_mae', 4, 'test_mae')}, {rd('sqrt(train_mse)', 4, 'train_rmse')}, {rd('sqrt(test_mse)', 4, 'test_rmse')},
  {rd('r2tr - r2te', 4, 'r2_difference')}, {rd("case when train_mae > 0 then test_mae / train_mae else 'inf'::double end", 4, 'mae_ratio')},
  {rd('case when r2tr > 0 then r2te / r2tr else 0 end', 4, 'generalization')} from m""")
def _baseline_forest_stump(t: Tables):
    # one tree of one split without resampling: the split SQL finds, fitted on every fifth order's complement
    rows = t.lineitem.select("l_orderkey", F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber")).alias("x"))
    split = validation.modulo_split(rows, "l_orderkey")
    model = trees.fit_forest(split.filter("split = 'train'"), "y", ["x"], trees=1, depth=1, bootstrap=False)
    scored = trees.predict_trees(split, model, ["x"], "_forest")
    return rounded(validation.split_metrics(scored, "y", {"random_forest": "_forest"}, 1), 4)


def _sparse_stump_sql(fill: int) -> str:
    return f"""with rows as (select case when l_orderkey % 6 <> 0 then l_linenumber end as x,
  l_extendedprice / 1000 + 10 * case when l_orderkey % 6 <> 0 then l_linenumber else {fill} end as y from lineitem),
base as (select avg(y) as b from rows),
tot as (select sum(b - y) as g, count(*)::double as h, coalesce(sum(b - y) filter (where x is null), 0) as gm,
  (count(*) filter (where x is null))::double as hm from rows, base),
cuts as (select v, sum(g) over (order by v) as gl, sum(h) over (order by v) as hl
  from (select x as v, sum(b - y) as g, count(*)::double as h from rows, base where x is not null group by x)),
cand as (select v, false as missing_left, gl as lg, hl as lh from cuts union all select v, true, gl + gm, hl + hm from cuts, tot),
scored as (select v, missing_left, lg, lh, t.g - lg as rg, t.h - lh as rh,
  lg * lg / (lh + 1) + (t.g - lg) * (t.g - lg) / (t.h - lh + 1) - t.g * t.g / (t.h + 1) as gain from cand, tot t where lh >= 1 and t.h - lh >= 1)
select v::double as threshold, missing_left, {rd('-lg / (lh + 1)', 4, 'left_weight')}, {rd('-rg / (rh + 1)', 4, 'right_weight')}
from scored order by gain desc, missing_left, v limit 1"""


def _sparse_stump(t: Tables, fill: int):
    # one tree of one split by the learner with learnt directions; gaps behave like line number ``fill``
    line = F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber"))
    rows = t.lineitem.select(line.alias("x"), (F.col("l_extendedprice") / 1000 + 10 * F.coalesce(line, F.lit(fill))).alias("y"))
    tree = boosting.fit(rows, "y", ["x"], trees=1, depth=1, rate=1.0).trees[0]
    _, at, left = tree.splits[0]
    found = t.spark.createDataFrame([(at, left, tree.leaves[1], tree.leaves[2])], "threshold double, missing_left boolean, left_weight double, right_weight double")
    return rounded(found, 4, "left_weight", "right_weight")


@query("sparse_stump_gaps_low", _sparse_stump_sql(1))
def _sparse_stump_gaps_low(t: Tables):
    return _sparse_stump(t, 1)


@query("sparse_stump_gaps_high", _sparse_stump_sql(8))
def _sparse_stump_gaps_high(t: Tables):
    return _sparse_stump(t, 8)


@query("shap_stump", f"""
with {STUMP}, base as (select sum(case when x <= v then low else high end) / count(*) as b from rows, best)
select l_orderkey, l_linenumber, l_partkey, {rd('b', 4, 'base_value')}, 'x' as feature, {rd('case when x <= v then low else high end - b', 4, 'contribution')} from rows, best, base""")
def _shap_stump(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber")).alias("x"))
    model = trees.fit_gbt(rows, "y", ["x"], trees=1, rate=1.0, depth=1)
    out = trees.tree_shap_blocks(rows, model, ["x"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "base_value", "feature", "contribution"), 4)


@query("brand_long", f"with {ADS} select city, month, brand, {rd('sum(grp)', 2, 'grp')} from ads where brand is not null group by all")
def _brand_long(t: Tables):
    return rounded(brand_long(ads(t), {"grp": "grp"}), 2)


@query("distinct_frequency", f"with {DATED} select id as value, count(*) as n from dated where id is not null group by id")
def _distinct_frequency(t: Tables):
    return frequency.value_counts(dated(t), ["id"], cast="bigint").select("value", "n")


# -- files: broken rows, reports of one name in two folders, predictions beside reports, stored trees


@query("load_broken", """
select 'good' as kind, count(*) as n, sum(c_custkey)::bigint as keys from customer where c_custkey % 7 <> 0
union all select 'broken', count(*), null from customer where c_custkey % 7 = 0""")
def _load_broken(t: Tables):
    path = scratch_path(t.spark, "broken")
    balance = F.when(F.col("c_custkey") % 7 == 0, "not a number").otherwise(F.col("c_acctbal").cast("string"))
    tables.write_csv(t.customer.select(F.col("c_custkey").alias("key"), balance.alias("balance")), path)
    good, broken = tables.read_csv_checked(t.spark, path, "key long, balance double")
    return good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")).unionByName(
        broken.agg(F.lit("broken").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("keys"))
    )


def nation_reports(t: Tables):
    """Report texts of every region: (file, text); the model is the region's number."""
    rows = t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(
        F.struct(F.concat(F.lit("region_"), F.col("n_regionkey")).alias("model_name")).alias("report_metadata"),
        F.struct(F.col("n").alias("total_observations")).alias("dataset_overview"), F.struct(F.col("n").alias("rows")).alias("model_configuration"),
    ))
    file = F.concat(F.lit("r"), F.col("n_regionkey"), F.lit(reports.REPORT_SUFFIX))
    return rows.select(file.alias("file"), body.alias("text"))


def written_reports(t: Tables):
    """The same files in two folders, the second with one more nation each."""
    folder = scratch_path(t.spark, "reports")
    texts = nation_reports(t)
    for place, change in (("a", F.col("text")), ("b", F.regexp_replace("text", r'"rows":(\d+)', '"rows":1$1'))):
        # the tasks that hold the reports write them, one file each; nothing passes through the driver
        reports.write_report_files(texts.select("file", change.alias("text")), f"{folder}/{place}")
    rows = t.spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    name = F.regexp_extract(path, r"file_name=([^/]+)/[^/]*$", 1)
    return rows.select(name.alias("file"), path.alias("path"), F.col("value").alias("text"))


@query("report_file_scan", "select 'r' || n_regionkey || '_comprehensive_report.json' as file, 'region_' || n_regionkey as model, f as folder from nation, (select unnest(['a', 'b']) as f) group by all")
def _report_file_scan(t: Tables):
    return reports.parse_reports(written_reports(t)).select("file", "model", F.regexp_extract("path", "/([ab])/", 1).alias("folder"))


@query("combine_same_names", """
select 'region_' || n_regionkey as model, 'model_configuration' as section, cast('1' || count(*) as bigint) as rows from nation group by n_regionkey
union all select 'region_' || n_regionkey, 'report_metadata', null from nation group by n_regionkey union all select null, 'dataset_overview', null""")
def _combine_same_names(t: Tables):
    combined = reports.combine_reports(reports.parse_reports(written_reports(t)))
    return combined.select("model", "section", F.get_json_object("content", "$.rows").cast("long").alias("rows"))


def combined_with_predictions(t: Tables):
    predictions = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("region_"), F.col("n_regionkey")).alias("model"), F.col("s_acctbal").alias("prediction"))
    predictions = predictions.filter("model <> 'region_0'").unionByName(t.part.select(F.lit("extra").alias("model"), F.col("p_retailprice").alias("prediction")))
    return reports.attach_predictions(reports.combine_reports(reports.parse_reports(nation_reports(t))), predictions)


PREDICTED = "p as (select 'region_' || n_regionkey as model, s_acctbal as prediction from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 0 union all select 'extra', p_retailprice from part)"


@query("combined_predictions", f"""
with {PREDICTED} select model, 'predictions' as section, count(*) as total, {rd('avg(prediction)', 3, 'mean')}, {rd('stddev_samp(prediction)', 3, 'std')}, {rd('min(prediction)', 3, 'min')}, {rd('max(prediction)', 3, 'max')} from p group by model
union all select 'region_' || n_regionkey, s, null, null, null, null, null from nation, (select unnest(['report_metadata', 'model_configuration']) as s) group by all
union all select null, 'dataset_overview', null, null, null, null, null""")
def _combined_predictions(t: Tables):
    sections, _ = combined_with_predictions(t)
    at = lambda path, kind: F.when(F.col("section") == "predictions", F.get_json_object("content", path)).cast(kind)
    figures = [at(f"$.prediction_summary.{c}", "double").alias(c) for c in ("mean", "std", "min", "max")]
    return rounded(sections.select("model", "section", at("$.total_predictions", "long").alias("total"), *figures), 3)


@query("combined_metadata", f"""
with {PREDICTED}, m as (select distinct model from p), r as (select distinct 'region_' || n_regionkey as model from nation)
select (select string_agg(model, ',' order by model) from r) as combined_from, (select string_agg(model, ',' order by model) from m) as prediction_files,
  (select count(*) from r) as total_models, (select count(*) from m) as total_prediction_sets""")
def _combined_metadata(t: Tables):
    _, metadata = combined_with_predictions(t)
    return metadata.withColumns({c: F.array_join(c, ",") for c in ("combined_from", "prediction_files")})


@query("model_store_trees", "select count(*) as rows, 0::bigint as differing, 'l_quantity,l_discount' as columns from lineitem")
def _model_store_trees(t: Tables):
    folder = scratch_path(t.spark, "models")
    columns = ["l_quantity", "l_discount"]
    model = trees.fit_gbt(t.lineitem, "l_extendedprice", columns, trees=3, depth=3)
    tables.save_tree_model(model, columns, folder, "gbt")
    again, names = tables.load_tree_model(t.spark, folder, "gbt")
    both = trees.predict_trees(trees.predict_trees(t.lineitem, model, columns, "before"), again, names, "after")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("differing"), F.lit(",".join(names)).alias("columns"))


@query("model_store_stump", f"with {STUMP} select l_orderkey, l_linenumber, l_partkey, {rd('case when x <= v then low else high end', 4, 'prediction')} from rows, best")
def _model_store_stump(t: Tables):
    # a one-split model stored and loaded again must still give the split that SQL grows
    folder = scratch_path(t.spark, "models")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber")).alias("x"))
    tables.save_tree_model(trees.fit_gbt(rows, "y", ["x"], trees=1, rate=1.0, depth=1), ["x"], folder, "stump")
    again, names = tables.load_tree_model(t.spark, folder, "stump")
    return rounded(trees.predict_trees(rows, again, names).select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 4)


# -- p-values by numeric integration of the t density

SMALL = """small as (select c_nationkey, avg(o_totalprice) as y, cast(count(*) as double) as x1, avg(c_acctbal) as x2 from orders join customer on o_custkey = c_custkey group by c_nationkey)"""


@query("inference_p_values", f"""
with {SMALL}, {two_feature_ols('small', 'y', 'x1', 'x2')}, s as (select *, sse / (n - 3) as s2, s11 * s22 - s12 * s12 as d, cast(n - 3 as double) as v from beta),
e as (select 'intercept' as term, b0 as b, v, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * d))) as se from s
  union all select 'x1', b1, v, sqrt(s2 * s22 / (n * d)) from s union all select 'x2', b2, v, sqrt(s2 * s11 / (n * d)) from s),
q as (select term, b, v, abs(b / se) as t, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) as k from e),
-- Simpson's rule over 0..t with 4000 steps
i as (select term, any_value(b) as b, sum(case when j = 0 or j = 4000 then 1 when j % 2 = 1 then 4 else 2 end * k * (1 + (t * j / 4000) ** 2 / v) ** (-(v + 1) / 2)) * any_value(t) / 4000 / 3 as half
  from q, (select unnest(range(0, 4001)) as j) group by term),
p as (select term, b, greatest(0.0, 1 - 2 * half) as p from i)
select term, {rd('p', 6, 'p_value')}, p < 0.05 as significant, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars,
  case when b > 0 then 'positive_effect' else 'negative_effect' end as direction from p""")
def _inference_p_values(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("x1"), F.avg("c_acctbal").alias("x2")
    )
    out = linear.inference(t.spark, linear.fit_ols(rows, "y", ["x1", "x2"]))
    return rounded(out.select("term", "p_value", "significant", "stars", "direction"), 6)


# -- reports of other models, numbers rounded for the comparison

def figures(report):
    """(section, item, metric, number): the numeric metrics of a report, rounded."""
    number = F.round(F.col("value").try_cast("double"), 4)
    return report.select("section", "item", "metric", number.alias("number")).filter("number is not null")


def long_sql(name: str, rows: str, item: str, metrics: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as section, {item} as item, '{m}' as metric, {rd(f'cast({e} as double)', 4)} as number from {rows}" for m, e in metrics.items())


@query("model_report_did", f"""
with {DID}, ct as (select coalesce('treated=' || cast(treated as varchar), 'treated=All') || '|' || coalesce('post=' || cast(post as varchar), 'post=All') as cell, count(*) as n from flagged group by cube (treated, post)),
b as (select min(n) as lo, max(n) as hi from (select count(*) as n from flagged group by treated, post)),
cm as (select 'post=' || post as post, avg(o_totalprice) filter (treated = 0) as c, avg(o_totalprice) filter (treated = 1) as t from flagged group by post)
{long_sql('design', 'ct', 'cell', {'n': 'n'})}
union all {long_sql('design_balance', 'b', "'all'", {'min_cell': 'lo', 'max_cell': 'hi', 'balance_ratio': 'lo * 1.0 / hi'})}
union all {long_sql('cell_means', 'cm', 'post', {'control_mean': 'c', 'treated_mean': 't'})}
union all {long_sql('effect', 'did, w, tot', "'all'", {'ate': 'ate', 'r_squared': '1 - sse / sst', 'observations': 'n'})}
union all {long_sql('effect_size', 'did, tot', "'all'", {'ate': 'ate', 'effect_size': 'abs(ate) / sd'})}""")
def _model_report_did(t: Tables):
    out = figures(report.did_report(did_orders(t), "o_totalprice", ["c_acctbal"]))
    tested = {"effect": ("ate", "r_squared", "observations"), "effect_size": ("ate", "effect_size")}
    keep = F.lit(True)
    for name, metrics in tested.items():
        keep = keep & ((F.col("section") != name) | F.col("metric").isin(*metrics))
    return out.filter(keep & (F.col("section") != "coefficients"))


@query("model_report_shap", f"""
with {STUMP}, s as (select y, x, case when x <= v then low else high end as p, (select sum(case when x <= v then low else high end) / count(*) from rows, best) as b from rows, best)
{long_sql('shap_importance', "(select avg(abs(p - b)) as i, min(p - b) as lo, max(p - b) as hi, count(*) filter (p > b) as pos, count(*) filter (p < b) as neg from s)", "'x'",
  {'mean_abs_shap': 'i', 'min': 'lo', 'max': 'hi', 'positive': 'pos', 'negative': 'neg', 'importance_rank': '1', 'importance_percent': '100'})}
union all {long_sql('tree_importance', '(select 1.0 as i)', "'x'", {'importance': 'i', 'importance_rank': 'i', 'importance_percent': '100'})}
union all {long_sql('attribution', '(select any_value(b) as b from s)', "'all'", {'base_value': 'b', 'features': '1'})}
union all {long_sql('predictions_summary', '(select count(p) as n, avg(p) as m, stddev_samp(p) as d, min(p) as lo, max(p) as hi from s)', "'all'", {'prediction_count': 'n', 'mean': 'm', 'std': 'd', 'min': 'lo', 'max': 'hi'})}
union all {long_sql('model_performance', '(select count(*) as n, 1 - avg((y - p) ** 2) / var_pop(y) as r, avg(abs(y - p)) as a, sqrt(avg((y - p) ** 2)) as q from s)', "'all'", {'observations': 'n', 'r_squared': 'r', 'mae': 'a', 'rmse': 'q'})}""")
def _model_report_shap(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("y"), F.when(F.col("l_orderkey") % 6 != 0, F.col("l_linenumber")).alias("x"))
    model = trees.fit_gbt(rows, "y", ["x"], trees=1, rate=1.0, depth=1)
    attributions = trees.tree_shap(rows, model, ["x"], ["l_orderkey", "l_linenumber", "l_partkey"])
    scored = trees.predict_trees(rows, model, ["x"])
    out = figures(report.shap_report(attributions, trees.importance_tree(t.spark, model, ["x"]), scored, "y"))
    keep = (F.col("section") != "model_performance") | F.col("metric").isin("observations", "r_squared", "mae", "rmse")
    return out.filter(keep & ((F.col("section") != "shap_importance") | ~F.col("metric").isin("mean", "std", "neutral", "concentration")))


@query("model_report_series", f"""
with {HOURLY}, o as (select *, row_number() over (partition by event_type order by hour) as rn, floor(0.8 * count(*) over (partition by event_type)) as cut from hourly),
ends as (select event_type, max(value) filter (rn = cut) as last, (max(value) filter (rn = cut) - max(value) filter (rn = 1)) / (any_value(cut) - 1) as slope from o group by event_type),
s as (select o.event_type, value as y, last + (rn - cut) * slope as p from o join ends using (event_type) where rn > cut),
h as (select event_type, count(*) as n, avg(abs(y - p)) as a, avg((y - p) ** 2) as q from s group by event_type), f as (select event_type, count(*) as n from hourly group by event_type)
{long_sql('forecast', 'f', 'event_type', {'historical': 'n', 'forecast': '12'})}
union all {long_sql('holdout', 'h', 'event_type', {'test_size': 'n', 'mae': 'a', 'mse': 'q', 'rmse': 'sqrt(q)'})}""")
def _model_report_series(t: Tables):
    rows = hourly(t).drop("n")
    both = series.forecast(rows, "hour", "value", 12, ["event_type"], step=3600)
    out = figures(report.series_report(both, series.holdout_metrics(rows, "hour", "value", ["event_type"]), "event_type"))
    return out.filter(~F.col("metric").isin("lowest", "highest", "mape"))


@query("f_test_small", f"""
with {SMALL}, {two_feature_ols('small', 'y', 'x1', 'x2')}
select {rd('((sst - sse) / 2) / (sse / (n - 3))', 6, 'f_statistic')}, {rd('(1 + (sst - sse) / sse) ** (-(n - 3) / 2.0)', 6, 'f_pvalue')} from beta""")
def _f_test_small(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("x1"), F.avg("c_acctbal").alias("x2")
    )
    return rounded(linear.ols_summary(t.spark, linear.fit_ols(rows, "y", ["x1", "x2"])).select("f_statistic", "f_pvalue"), 6)


@query("shap_adds_up", "select count(*) as rows, count(*) as adding_up from lineitem")
def _shap_adds_up(t: Tables):
    """A forest of several deep trees: base value and contributions of a row add up to its prediction."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    model = trees.fit_gbt(t.lineitem, "l_extendedprice", columns, trees=10, rate=0.3, depth=5)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    scored = trees.predict_trees(t.lineitem.select(*keys, *columns), model, columns)
    parts = trees.tree_shap(scored, model, columns, [*keys, "prediction"])
    sums = parts.groupBy(*keys, "prediction").agg((F.sum("contribution") + F.max("base_value")).alias("total"), F.count(F.lit(1)).alias("n"))
    rows = F.sum(F.col("n") / len(columns)).cast("long")
    return sums.agg(rows.alias("rows"), F.sum(F.when(F.abs(F.col("total") - F.col("prediction")) < 1e-6 * F.abs("prediction"), F.col("n") / len(columns))).cast("long").alias("adding_up"))
