"""Models: regression, effects, matching, series, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators import arma, causal, gram, linear, series, smoothing
from panelift.operators.ordered import add_lags, modal_step, running_effect
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.cleaning_queries import FLAGGED, did_orders
from panelift.plans.shared import ADS, CALENDAR, CLIENT, COUNTS, GEO, HOURLY, SUMS, VISITS, ads, hourly, two_feature_ols, visits
from panelift.functions.columns import label_encode
from panelift.operators import panel

FEATURES = ["l_quantity", "l_discount"]
LINE_OLS = two_feature_ols("lineitem", "l_extendedprice", "l_quantity", "l_discount")
TERMS = "(select 0 as position, 'intercept' as term, b0 as b from beta union all select 1, 'l_quantity', b1 from beta union all select 2, 'l_discount', b2 from beta)"
LINE_KEY = "l_orderkey, l_linenumber"


def line_fit(t: Tables):
    return linear.fit_ols(t.lineitem, "l_extendedprice", FEATURES)


PANEL2 = f"""monthly as (select city, month, coalesce(sum(case when brand = '{CLIENT}' then grp end), 0) as client_grp,
    coalesce(sum(case when brand <> '{CLIENT}' then grp end), 0) as competitor_grp from ads group by city, month),
panel as (select city, year, week, visits, coalesce(client_grp / cast(weeks_in_month as double), 0) as client_grp, coalesce(competitor_grp / cast(weeks_in_month as double), 0) as competitor_grp
  from visits left join (select * from monthly join calendar using (month)) using (city, year, week))"""


def ad_panel(t: Tables) -> DataFrame:
    """Weekly visits with client and competitor activity."""
    return panel.build_panel(visits(t), ads(t), CLIENT, {"grp": "grp"}, {})


@query("panel_contributions", f"""
with {ADS}, {VISITS}, {CALENDAR}, {PANEL2}, {two_feature_ols('panel', 'visits', 'client_grp', 'competitor_grp')}
select city, {rd('sum(client_grp * b1)', 4, 'client_contribution')}, {rd('sum(competitor_grp * b2)', 4, 'competitor_contribution')},
  {rd('sum(b0 + b1 * client_grp + b2 * competitor_grp)', 4, 'fitted_visits')}, cast(sum(visits) as bigint) as visits from panel, beta group by city""")
def panel_contributions(t: Tables) -> DataFrame:
    """Flagship: weekly panel, regression of visits on activity, contributions per city."""
    from panelift.session import spill

    rows = spill(ad_panel(t).select("city", "year", "week", "visits", "client_grp", "competitor_grp"), "panel")
    features = ["client_grp", "competitor_grp"]
    fit = linear.fit_ols(rows, "visits", features)
    long = linear.contributions(linear.predict(rows, fit), fit, ["city", "year", "week", "visits", "prediction"])
    of = lambda c: F.sum(F.when(F.col("feature") == c, F.col("contribution")))
    once = F.col("feature") == features[0]
    out = long.groupBy("city").agg(
        of("client_grp").alias("client_contribution"), of("competitor_grp").alias("competitor_contribution"),
        F.sum(F.when(once, F.col("prediction"))).alias("fitted_visits"), F.sum(F.when(once, F.col("visits"))).alias("visits"),
    )
    return rounded(out, 4)


@query("ols_coefficients", f"with {LINE_OLS} select position, term, {rd('b', 4, 'coefficient')} from {TERMS}")
def _ols_coefficients(t: Tables):
    return rounded(linear.coefficients(t.spark, line_fit(t)), 4)


@query("ols_qr_coefficients", f"with {LINE_OLS} select position, term, {rd('b', 4, 'coefficient')} from {TERMS}")
def _ols_qr_coefficients(t: Tables):
    # the same fit as ols_coefficients by a tall-skinny QR of the rows instead of their moments
    return rounded(linear.coefficients(t.spark, gram.fit_ols_qr(t.lineitem, "l_extendedprice", FEATURES)), 4)


@query("ols_predict", f"with {LINE_OLS} select {LINE_KEY}, {rd('b0 + b1 * l_quantity + b2 * l_discount', 4, 'prediction')} from lineitem, beta")
def _ols_predict(t: Tables):
    return rounded(linear.predict(t.lineitem, line_fit(t)).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query("contributions", f"""
with {LINE_OLS} select {LINE_KEY}, 'l_quantity' as feature, l_quantity as value, {rd('b1 * l_quantity', 4, 'contribution')} from lineitem, beta
union all select {LINE_KEY}, 'l_discount', l_discount, {rd('b2 * l_discount', 4)} from lineitem, beta""")
def _contributions(t: Tables):
    return rounded(linear.contributions(t.lineitem, line_fit(t), ["l_orderkey", "l_linenumber"]), 4, "contribution")


def _contribution_sql(c: str, b: str) -> str:
    return f"""select '{c}' as feature, {rd(f'any_value({b})', 4, 'coefficient')}, {rd(f'sum({b} * {c})', 2, 'total')}, {rd(f'avg({b} * {c})', 4, 'mean')},
  {rd(f'stddev_samp({b} * {c})', 4, 'std')}, {rd(f'min({b} * {c})', 4, 'min')}, {rd(f'max({b} * {c})', 4, 'max')},
  {rd(f'any_value({b}) * avg({c}) / avg(l_extendedprice)', 6, 'elasticity')}, case when any_value({b}) > 0 then 'increases' else 'decreases' end as direction from lineitem, beta"""


@query("contribution_summary", f"with {LINE_OLS} {_contribution_sql('l_quantity', 'b1')} union all {_contribution_sql('l_discount', 'b2')}")
def _contribution_summary(t: Tables):
    out = linear.contribution_summary(t.lineitem, line_fit(t))
    return rounded(rounded(rounded(out, 2, "total"), 6, "elasticity"), 4, "coefficient", "mean", "std", "min", "max")


LAGGED = "lagged as (select *, lag(value) over w as v1, lag(value, 2) over w as v2, lag(value, 3) over w as v3 from hourly window w as (partition by event_type order by hour))"


@query("lag_features", f"with {HOURLY}, {LAGGED} select event_type, hour, {rd('value', 4, 'value')}, {rd('v1', 4, 'value_lag1')}, {rd('v2', 4, 'value_lag2')}, {rd('v3', 4, 'value_lag3')} from lagged")
def _lag_features(t: Tables):
    return rounded(add_lags(hourly(t).drop("n"), ["value"], 3, ["hour"], ["event_type"]), 4)


@query("distributed_lag", f"with {HOURLY}, {LAGGED}, {two_feature_ols('lagged', 'n', 'v1', 'v2')} select position, replace(replace(term, 'l_quantity', 'value_lag1'), 'l_discount', 'value_lag2') as term, {rd('b', 6, 'coefficient')} from {TERMS}")
def _distributed_lag(t: Tables):
    fit, _ = linear.distributed_lag(hourly(t), "n", ["value"], ["hour"], ["event_type"], max_lag=2)
    return rounded(linear.coefficients(t.spark, fit), 6)


@query("lag_significance")
def _lag_significance(t: Tables):
    fit, _ = linear.distributed_lag(hourly(t), "n", ["value"], ["hour"], ["event_type"])
    return linear.lag_significance(linear.inference(t.spark, fit))


@query("lag_significance_two", f"""
with {HOURLY}, {LAGGED}, {two_feature_ols('lagged', 'n', 'v1', 'v2')},
s as (select *, sse / (n - 3) as s2, s11 * s22 - s12 * s12 as d, cast(n - 3 as double) as v from beta),
e as (select 'value_lag1' as term, b1 as b, v, sqrt(s2 * s22 / (n * d)) as se from s union all select 'value_lag2', b2, v, sqrt(s2 * s11 / (n * d)) from s),
q as (select term, v, abs(b / se) as t, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) as k from e),
-- Simpson's rule over 0..t with 4000 steps
i as (select term, sum(case when j = 0 or j = 4000 then 1 when j % 2 = 1 then 4 else 2 end * k * (1 + (t * j / 4000) ** 2 / v) ** (-(v + 1) / 2)) * any_value(t) / 4000 / 3 as half
  from q, (select unnest(range(0, 4001)) as j) group by term),
p as (select term, greatest(0.0, 1 - 2 * half) as p from i)
select term, {rd('p', 6, 'p_value')}, p < 0.05 as significant from p""")
def _lag_significance_two(t: Tables):
    fit, _ = linear.distributed_lag(hourly(t), "n", ["value"], ["hour"], ["event_type"], max_lag=2)
    return rounded(linear.lag_significance(linear.inference(t.spark, fit)), 6, "p_value")


@query("max_lag_order", "select 7 as max_lag, cast(7 as bigint) as lag_terms from (select count(*) from events)")
def _max_lag_order(t: Tables):
    fit, _ = linear.distributed_lag(hourly(t), "n", ["value"], ["hour"], ["event_type"])
    return linear.max_lag_order(linear.coefficients(t.spark, fit))


DID = f"""{GEO}, {FLAGGED}, cells as (
  select treated, post, count(*) as n, avg(o_totalprice) as y, avg(c_acctbal) as x, covar_pop(c_acctbal, o_totalprice) * count(*) as sxy,
         var_pop(c_acctbal) * count(*) as sxx, var_pop(o_totalprice) * count(*) as syy from flagged group by treated, post),
w as (select sum(sxy) / sum(sxx) as b, sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) as sse, sum(n) as n from cells),
adj as (select treated, post, y - b * x as a from cells, w),
did as (select max(a) filter (treated = 1 and post = 1) - max(a) filter (treated = 1 and post = 0) - max(a) filter (treated = 0 and post = 1) + max(a) filter (treated = 0 and post = 0) as ate from adj),
tot as (select var_pop(o_totalprice) * count(*) as sst, stddev_samp(o_totalprice) as sd from flagged)"""


@query("did_effect", f"with {DID} select {rd('ate', 4, 'ate')}, {rd('1 - sse / sst', 8, 'r_squared')}, {rd('((sst - sse) / 4) / (sse / (n - 5))', 4, 'f_statistic')}, cast(n as bigint) as observations from did, w, tot")
def _did_effect(t: Tables):
    fit, _ = causal.did_fit(did_orders(t), "o_totalprice", ["c_acctbal"])
    out = causal.did_effect(t.spark, fit).select("ate", "r_squared", "f_statistic", "observations")
    return rounded(rounded(out, 4, "ate", "f_statistic"), 8, "r_squared")


@query("did_absorbed", f"""
with {GEO}, {FLAGGED},
d as (select o_totalprice - avg(o_totalprice) over (partition by c_custkey) as y, post - avg(post) over (partition by c_custkey) as p,
  treated * post - avg(treated * post) over (partition by c_custkey) as i from flagged),
s as (select sum(p * p) as pp, sum(i * i) as ii, sum(p * i) as pi, sum(p * y) as py, sum(i * y) as iy, sum(y * y) as yy, count(*) as n from d),
l as (select count(distinct c_custkey) as levels from flagged),
b as (select *, (ii * py - pi * iy) / (pp * ii - pi * pi) as bp, (pp * iy - pi * py) / (pp * ii - pi * pi) as bi from s)
select {rd('bi', 4, 'ate')}, {rd('sqrt((yy - bp * py - bi * iy) / (n - 2 - levels) * pp / (pp * ii - pi * pi))', 4, 'std_error')},
  {rd('1 - (yy - bp * py - bi * iy) / yy', 8, 'r_squared')}, n::bigint as observations, levels::bigint as absorbed_levels from b, l""")
def _did_absorbed(t: Tables):
    # every customer its own fixed effect, by demeaning within customers; treated is fixed within one and drops out
    rows = did_orders(t).withColumn("customer", F.col("c_custkey").cast("string"))
    out = causal.did_absorbed(rows, "o_totalprice", absorb=["customer"])
    return rounded(rounded(out, 8, "r_squared"), 4, "ate", "std_error").select("ate", "std_error", "r_squared", "observations", "absorbed_levels")


@query("did_inference")
def _did_inference(t: Tables):
    fit, _ = causal.did_fit(did_orders(t), "o_totalprice", ["c_acctbal", "o_orderpriority"])
    return causal.did_effect(t.spark, fit)


@query("did_effect_size", f"with {DID} select {rd('ate', 4, 'ate')}, {rd('abs(ate) / sd', 6, 'effect_size')}, case when abs(ate) / sd < 0.2 then 'small' when abs(ate) / sd < 0.5 then 'medium' else 'large' end as band from did, tot")
def _did_effect_size(t: Tables):
    fit, rows = causal.did_fit(did_orders(t), "o_totalprice", ["c_acctbal"])
    out = causal.did_effect_size(causal.did_effect(t.spark, fit), rows, "o_totalprice").select("ate", "effect_size", "band")
    return rounded(rounded(out, 4, "ate"), 6, "effect_size")


SC = f"""{ADS}, {VISITS}, {CALENDAR}, {PANEL2}, flagged as (select *, case when city = 'NATION_3' then 1 else 0 end as treated from panel),
control as (select * from flagged where treated = 0), {two_feature_ols('control', 'visits', 'client_grp', 'competitor_grp')},
sc as (select city, year, week, treated, cast(visits as double) as actual, case when treated = 0 then visits else b1 * client_grp + b2 * competitor_grp end as synthetic from flagged, beta)"""


def _sc_rows(t: Tables) -> DataFrame:
    from panelift.operators.design import prepare_synthetic_control
    from panelift.session import spill

    rows = spill(ad_panel(t).select("city", "year", "week", "visits", "client_grp", "competitor_grp"), "panel")
    flagged, _ = prepare_synthetic_control(rows, "city", "NATION_3")
    return causal.synthetic_control(flagged, "visits", ["client_grp", "competitor_grp"])[1]


@query("synthetic_control", f"with {SC} select city, year, week, treated, actual, {rd('synthetic', 4, 'synthetic')} from sc")
def _synthetic_control(t: Tables):
    return rounded(_sc_rows(t).select("city", "year", "week", "treated", "actual", "synthetic"), 4, "synthetic")


@query("sc_diagnostics", f"with {SC}, e as (select treated, actual - synthetic as g from sc) select " + ", ".join([
    rd("sqrt(avg(g * g))", 6, "rmspe"), rd("avg(g * g)", 6, "mspe"), rd("avg(abs(g))", 6, "mae"), rd("sqrt(avg(g * g) filter (treated = 1))", 6, "rmspe_treated"),
    rd("avg(g)", 6, "mean_effect"), rd("sum(g)", 4, "cumulative_effect"), rd("stddev_samp(g)", 6, "effect_std"), rd("min(g)", 6, "min_effect"), rd("max(g)", 6, "max_effect")]) + " from e")
def _sc_diagnostics(t: Tables):
    out = causal.sc_diagnostics(_sc_rows(t))
    return rounded(rounded(out, 4, "cumulative_effect"), 6, *[c for c in out.columns if c != "cumulative_effect"])


MATCH = """totals as (select o_custkey, sum(o_totalprice) as spend, count(*) as n from orders group by o_custkey),
people as (select c_custkey, c_acctbal, c_nationkey, case when c_mktsegment = 'BUILDING' then 1 else 0 end as treated, coalesce(spend, 0) as spend, coalesce(n, 0) as n
  from customer left join totals on c_custkey = o_custkey)"""


def people(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n"))
    joined = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", "c_acctbal", "c_nationkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"),
        F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce("n", F.lit(0)).alias("n"),
    )


SCORE = f"{MATCH}, {two_feature_ols('people', 'treated', 'c_acctbal', 'c_nationkey')}, scored as (select people.*, b0 + b1 * c_acctbal + b2 * c_nationkey as propensity from people, beta)"


@query("zscore", "select c_custkey, " + rd("(c_acctbal - m) / s", 6, "c_acctbal_z") + " from customer, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)")
def _zscore(t: Tables):
    return rounded(causal.zscore(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", "c_acctbal_z"), 6)


@query("propensity_score", f"with {SCORE} select c_custkey, treated, {rd('propensity', 6, 'propensity')} from scored")
def _propensity_score(t: Tables):
    return rounded(causal.propensity_score(people(t), ["c_acctbal", "c_nationkey"]).select("c_custkey", "treated", "propensity"), 6)


# Matching on the balance itself, so that both engines see exactly equal scores.
NEAREST = f"""{MATCH}, near as (
  select *, last_value(case when treated = 0 then c_custkey end ignore nulls) over b as bk, last_value(case when treated = 0 then c_acctbal end ignore nulls) over b as bs,
    first_value(case when treated = 0 then c_custkey end ignore nulls) over a as ak, first_value(case when treated = 0 then c_acctbal end ignore nulls) over a as asc_
  from people window b as (order by c_acctbal, c_custkey rows between unbounded preceding and current row), a as (order by c_acctbal, c_custkey rows between current row and unbounded following)),
paired as (select c_custkey, c_acctbal, spend, case when low then bk else ak end as match_key, case when low then bs else asc_ end as match_score,
    case when low then c_acctbal - bs else asc_ - c_acctbal end as gap
  from (select *, bk is not null and (ak is null or c_acctbal - bs <= asc_ - c_acctbal) as low from near where treated = 1)),
matched as (select paired.*, people.spend as match_spend from paired left join people on people.c_custkey = match_key)"""


def matches(t: Tables) -> DataFrame:
    return causal.nearest_match(people(t), "c_acctbal", "c_custkey", ["spend"])


@query("nearest_match", f"with {NEAREST} select c_custkey, c_acctbal, {rd('spend', 2, 'spend')}, match_key, match_score, {rd('match_spend', 2, 'match_spend')}, {rd('gap', 4, 'gap')} from matched")
def _nearest_match(t: Tables):
    return rounded(rounded(matches(t), 2, "spend", "match_spend"), 4, "gap")


@query("psm_att", f"""
with {NEAREST} select count(*) as treated_count, {rd('avg(spend)', 2, 'treated_mean')}, {rd('avg(match_spend)', 2, 'matched_mean')}, {rd('avg(spend) - avg(match_spend)', 2, 'att')},
  case when avg(spend) > avg(match_spend) then 'positive' else 'negative' end as direction from matched""")
def _psm_att(t: Tables):
    return rounded(causal.matched_att(matches(t), "spend"), 2)


def _balance_sql(c: str) -> str:
    return f"""select '{c}' as feature, {rd('mt', 4, 'treated_mean')}, {rd('mc', 4, 'control_mean')}, {rd('mm', 4, 'matched_mean')}, {rd('(mt - mc) / sd', 6, 'smd_before')}, {rd('(mt - mm) / sd', 6, 'smd_after')}
from (select avg({c}) filter (treated = 1) as mt, avg({c}) filter (treated = 0) as mc, sqrt((var_samp({c}) filter (treated = 1) + var_samp({c}) filter (treated = 0)) / 2) as sd from people),
     (select avg(p.{c}) as mm from matched join people p on p.c_custkey = match_key)"""


@query("psm_balance", f"with {NEAREST} {_balance_sql('c_acctbal')} union all {_balance_sql('spend')}")
def _psm_balance(t: Tables):
    out = causal.matching_balance(people(t), matches(t), ["c_acctbal", "spend"], "c_custkey")
    return rounded(rounded(out, 4, "treated_mean", "control_mean", "matched_mean"), 6, "smd_before", "smd_after")


VAR1 = "lag1 as (select *, lag(value) over w as x1, lag(n) over w as x2 from hourly window w as (partition by event_type order by hour))"


@query("var_fit", f"""
with {HOURLY}, {VAR1}, m as (select event_type, {', '.join(f"avg({c}) as m_{c}" for c in ('value', 'n', 'x1', 'x2'))}, covar_pop(x1, x1) as s11, covar_pop(x2, x2) as s22, covar_pop(x1, x2) as s12,
  covar_pop(x1, value) as sv1, covar_pop(x2, value) as sv2, covar_pop(x1, n) as sn1, covar_pop(x2, n) as sn2 from lag1 where x1 is not null group by event_type),
b as (select *, (s22 * sv1 - s12 * sv2) / d as v1, (s11 * sv2 - s12 * sv1) / d as v2, (s22 * sn1 - s12 * sn2) / d as n1, (s11 * sn2 - s12 * sn1) / d as n2 from (select *, s11 * s22 - s12 * s12 as d from m)),
r as (select event_type, 'value' as equation, 'const' as term, m_value - v1 * m_x1 - v2 * m_x2 as c from b union all select event_type, 'value', 'value.L1', v1 from b union all select event_type, 'value', 'n.L1', v2 from b
  union all select event_type, 'n', 'const', m_n - n1 * m_x1 - n2 * m_x2 from b union all select event_type, 'n', 'value.L1', n1 from b union all select event_type, 'n', 'n.L1', n2 from b)
select event_type, 1 as lag_order, equation, term, {rd('c', 5, 'coefficient')} from r""")
def _var_fit(t: Tables):
    stats = series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"])
    return rounded(stats.coefficients(order=1), 5)


VARB = f"""{HOURLY}, {VAR1}, m as (select event_type, count(*) as n, {', '.join(f"avg({c}) as m_{c}" for c in ('value', 'n', 'x1', 'x2'))}, covar_pop(x1, x1) as s11, covar_pop(x2, x2) as s22, covar_pop(x1, x2) as s12,
  covar_pop(x1, value) as sv1, covar_pop(x2, value) as sv2, covar_pop(x1, n) as sn1, covar_pop(x2, n) as sn2 from lag1 where x1 is not null group by event_type),
b as (select *, m_value - v1 * m_x1 - v2 * m_x2 as cv, m_n - n1 * m_x1 - n2 * m_x2 as cn from (
  select *, (s22 * sv1 - s12 * sv2) / d as v1, (s11 * sv2 - s12 * sv1) / d as v2, (s22 * sn1 - s12 * sn2) / d as n1, (s11 * sn2 - s12 * sn1) / d as n2
  from (select *, s11 * s22 - s12 * s12 as d from m)))"""


@query("var_irf_order1", f"""
with recursive {VARB},
p as (select event_type, 0 as step, 1.0::double as e11, 0.0::double as e12, 0.0::double as e21, 1.0::double as e22,
    1.0::double as c11, 0.0::double as c12, 0.0::double as c21, 1.0::double as c22 from b
  union all
  select p.event_type, step + 1, e11 * v1 + e12 * n1, e11 * v2 + e12 * n2, e21 * v1 + e22 * n1, e21 * v2 + e22 * n2,
    c11 + e11 * v1 + e12 * n1, c12 + e11 * v2 + e12 * n2, c21 + e21 * v1 + e22 * n1, c22 + e21 * v2 + e22 * n2
  from p join b using (event_type) where step < 10)
select event_type, step::integer as step, impulse, response, {rd('effect', 6, 'effect')}, {rd('cumulative', 6, 'cumulative')} from (
  select event_type, step, 'value' as impulse, 'value' as response, e11 as effect, c11 as cumulative from p
  union all select event_type, step, 'n', 'value', e12, c12 from p
  union all select event_type, step, 'value', 'n', e21, c21 from p
  union all select event_type, step, 'n', 'n', e22, c22 from p)""")
def _var_irf_order1(t: Tables):
    stats = series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"])
    return rounded(stats.impulse_responses(order=1), 6, "effect", "cumulative")


@query("var_diagnostics_order1", f"""
with {VARB},
e as (select l.event_type, l.value - (cv + v1 * x1 + v2 * x2) as ev, l.n - (cn + n1 * x1 + n2 * x2) as en from lag1 l join b using (event_type) where x1 is not null),
s as (select event_type, count(*) as n, ln(avg(ev * ev) * avg(en * en) - avg(ev * en) * avg(ev * en)) as ld from e group by event_type),
r as (select *, v1 + n2 as tr, v1 * n2 - v2 * n1 as dt from b)
select event_type, 1 as lag_order, s.n::bigint as observations, {rd('ld + 12.0 / s.n', 6, 'aic')}, {rd('ld + ln(s.n) * 6 / s.n', 6, 'bic')},
  {rd('ld + 2 * ln(ln(s.n)) * 6 / s.n', 6, 'hqic')}, {rd('power((s.n + 3.0) / (s.n - 3.0), 2) * exp(ld)', 2, 'fpe')},
  {rd('case when tr * tr - 4 * dt >= 0 then greatest(abs(tr + sqrt(tr * tr - 4 * dt)), abs(tr - sqrt(tr * tr - 4 * dt))) / 2 else sqrt(dt) end', 6, 'largest_root')},
  (case when tr * tr - 4 * dt >= 0 then greatest(abs(tr + sqrt(tr * tr - 4 * dt)), abs(tr - sqrt(tr * tr - 4 * dt))) / 2 else sqrt(dt) end) < 1 as stable,
  4 as total_parameters, {rd('abs(cv) + abs(cn) + abs(v1) + abs(v2) + abs(n1) + abs(n2)', 5, 'coefficient_magnitude')}
from s join r using (event_type)""")
def _var_diagnostics_order1(t: Tables):
    stats = series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"])
    out = stats.diagnostics(order=1)
    return rounded(rounded(rounded(out, 6, "aic", "bic", "hqic", "largest_root"), 2, "fpe"), 5, "coefficient_magnitude")


@query("var_irf")
def _var_irf(t: Tables):
    return series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"]).impulse_responses()


@query("var_diagnostics")
def _var_diagnostics(t: Tables):
    return series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"]).diagnostics()


@query("var_importance")
def _var_importance(t: Tables):
    stats = series.VarStatistics(hourly(t), ["value", "n"], ["hour"], ["event_type"])
    return series.var_importance(stats.coefficients(), ["value", "n"], ["event_type"])


AR1 = f"""{HOURLY}, l as (select *, lag(value) over (partition by event_type order by hour) as v1 from hourly),
c as (select event_type, regr_slope(value, v1) as b, regr_intercept(value, v1) as a from l group by event_type),
e as (select l.event_type, hour, value as actual, a + b * v1 as prediction, value - (a + b * v1) as effect from l join c using (event_type))"""


@query("ar_impact", f"""
with {AR1} select event_type, hour, {rd('actual', 4, 'actual')}, {rd('prediction', 4, 'prediction')}, {rd('effect', 4, 'effect')},
  {rd('coalesce(sum(effect) over (partition by event_type order by hour rows between unbounded preceding and current row), 0)', 4, 'cumulative_effect')} from e""")
def _ar_impact(t: Tables):
    return rounded(series.ar_impact(hourly(t), "value", ["hour"], ["event_type"], order=1), 4)


@query("impact_summary", f"""
with {AR1} select event_type, {rd('sum(effect)', 4, 'cumulative_effect')}, {rd('avg(effect)', 4, 'average_effect')}, {rd('stddev_samp(effect)', 4, 'effect_std')}, {rd('sum(effect) / sum(actual) * 100', 6, 'relative_percent')}
from e group by event_type""")
def _impact_summary(t: Tables):
    out = series.impact_summary(series.ar_impact(hourly(t), "value", ["hour"], ["event_type"], order=1), ["event_type"])
    return rounded(rounded(out, 6, "relative_percent"), 4, "cumulative_effect", "average_effect", "effect_std")


ARMA11 = f"""{HOURLY}, l as (select *, row_number() over (partition by event_type order by hour) as rn,
  lag(value) over (partition by event_type order by hour) as v1 from hourly),
c as (select event_type, regr_slope(value, v1) as b, regr_intercept(value, v1) as a from l group by event_type),
s2 as (select *, lag(eps) over (partition by event_type order by hour) as e1 from (select l.*, value - (a + b * v1) as eps from l join c using (event_type))),
{two_feature_ols('s2', 'value', 'v1', 'e1', by='event_type')},
x as (select s2.event_type, s2.hour, s2.rn, s2.value, case when s2.v1 is not null then s2.value - (beta.b0 + beta.b1 * s2.v1) end as u, case when abs(beta.b2) > 1 then 1 / beta.b2 else beta.b2 end as theta
  from s2 join beta using (event_type)),
r as (select event_type, rn, u as e, coalesce(u, 0.0) as s from x where rn = 1
  union all
  select x.event_type, x.rn, x.u - x.theta * r.s, coalesce(x.u - x.theta * r.s, 0.0) from r join x on x.event_type = r.event_type and x.rn = r.rn + 1),
e as (select x.event_type, x.hour, x.value as actual, x.value - r.e as prediction, r.e as effect from x join r using (event_type, rn))"""


@query("arma_impact", f"""
with recursive {ARMA11} select event_type, hour, {rd('actual', 2, 'actual')}, {rd('prediction', 2, 'prediction')}, {rd('effect', 2, 'effect')},
  {rd('coalesce(sum(effect) over (partition by event_type order by hour rows between unbounded preceding and current row), 0)', 2, 'cumulative_effect')},
  1::integer as ar_order, 1::integer as ma_order from e""")
def _arma_impact(t: Tables):
    # Hannan-Rissanen with a long autoregression of one lag: the steps SQL can take. The two agree to about
    # 1e-11 of the values (up to 1e4 at sf0.01), so values are compared at two decimals.
    return rounded(arma.arma_impact(hourly(t), "value", ["hour"], ["event_type"], order=(1, 1), long_ar=1), 2)


@query("arma_impact_aic")
def _arma_impact_aic(t: Tables):
    return arma.arma_impact(hourly(t), "value", ["hour"], ["event_type"])


HOLT = f"""{HOURLY}, x as (select event_type, hour, value, row_number() over (partition by event_type order by hour) as rn from hourly),
r as (select event_type, rn, value::double as level, 0.0::double as trend, null::double as predicted from x where rn = 1
  union all
  select x.event_type, x.rn, 0.3 * x.value + 0.7 * (r.level + r.trend),
    0.1 * ((0.3 * x.value + 0.7 * (r.level + r.trend)) - r.level) + 0.9 * r.trend, r.level + r.trend
  from r join x on x.event_type = r.event_type and x.rn = r.rn + 1)"""


@query("smoothing_state", f"""
with recursive {HOLT} select x.event_type, x.hour, {rd('x.value', 4, 'actual')}, {rd('level', 4, 'level')}, {rd('trend', 4, 'trend')},
  {rd('predicted', 4, 'predicted')}, {rd('x.value - predicted', 4, 'error')} from x join r using (event_type, rn)""")
def _smoothing_state(t: Tables):
    out = smoothing.smoothed(hourly(t), "hour", "value", ["event_type"])
    return rounded(out.select("event_type", "hour", "actual", "level", "trend", "predicted", "error"), 4)


@query("forecast_paths")
def _forecast_paths(t: Tables):
    return smoothing.sampled_forecast(hourly(t).drop("n"), "hour", "value", 12, ["event_type"], step=3600)


@query("ar_impact_aic")
def _ar_impact_aic(t: Tables):
    return series.ar_impact(hourly(t), "value", ["hour"], ["event_type"], difference=1)


@query("cumulative_effect", f"""
with {VISITS} select city, year, week, {rd('sales - promo_sales', 2, 'effect')}, {rd('sum(sales - promo_sales) over (partition by city order by year, week rows between unbounded preceding and current row)', 2, 'cumulative_effect')} from visits""")
def _cumulative_effect(t: Tables):
    out = running_effect(visits(t), "sales", "promo_sales", ["year", "week"], ["city"])
    return rounded(out.select("city", "year", "week", "effect", "cumulative_effect"), 2)


@query("infer_step", f"""
with {HOURLY}, d as (select event_type, cast(epoch(hour) - lag(epoch(hour)) over (partition by event_type order by hour) as bigint) as step from hourly),
c as (select event_type, step, count(*) as n from d where step is not null group by all)
select event_type, step, n as step_count from c qualify row_number() over (partition by event_type order by n desc, step) = 1""")
def _infer_step(t: Tables):
    rows = hourly(t).withColumn("second", F.unix_seconds(F.col("hour").cast("timestamp")))
    return modal_step(rows, "second", ["event_type"])


@query("future_keys", f"""
with {HOURLY}, l as (select event_type, max(hour) as hour from hourly group by event_type)
select event_type, cast(h as int) as h, hour + h * interval 1 hour as hour from l, (select unnest(range(1, 13)) as h)""")
def _future_keys(t: Tables):
    last = hourly(t).groupBy("event_type").agg(F.max("hour").alias("hour")).withColumn("step", F.lit(3600))
    return series.future_keys(last, 12, "hour").select("event_type", "h", "hour")


FORECAST = f"""{HOURLY}, o as (select *, lag(value) over w as prev, row_number() over w as rn, count(*) over (partition by event_type) as cnt from hourly window w as (partition by event_type order by hour)),
ends as (select event_type, max(hour) as last_hour, max(value) filter (rn = cnt) as last, (max(value) filter (rn = cnt) - max(value) filter (rn = 1)) / (max(cnt) - 1) as drift from o group by event_type),
err as (select o.event_type, value - prev - drift as e from o join ends using (event_type) where prev is not null),
q as (select event_type, quantile_cont(e, 0.1) as q10, quantile_cont(e, 0.9) as q90 from err group by event_type)"""


@query("forecast_frame", f"""
with {FORECAST} select event_type, hour, {rd('value', 4, 'actual')}, {rd('value', 4, 'predicted')}, {rd('value', 4, 'lower')}, {rd('value', 4, 'upper')}, 'historical' as data_type from hourly
union all select event_type, last_hour + h * interval 1 hour, null, {rd('last + h * drift', 4)}, {rd('last + h * drift + q10 * sqrt(h)', 4)}, {rd('last + h * drift + q90 * sqrt(h)', 4)}, 'forecast'
from ends join q using (event_type), (select unnest(range(1, 13)) as h)""")
def _forecast_frame(t: Tables):
    return rounded(series.forecast(hourly(t).drop("n"), "hour", "value", 12, ["event_type"], step=3600), 4)


SEASON = f"""{HOURLY}, o as (select *, lag(value, 24) over w as prev, row_number() over w as rn, count(*) over (partition by event_type) as cnt from hourly window w as (partition by event_type order by hour)),
q as (select event_type, max(hour) as last_hour, quantile_cont(value - prev, 0.1) filter (prev is not null) as q10, quantile_cont(value - prev, 0.9) filter (prev is not null) as q90 from o group by event_type),
tail as (select event_type, rn - cnt + 24 as place, value from o where rn > cnt - 24)"""


@query("forecast_seasonal", f"""
with {SEASON} select event_type, last_hour + h * interval 1 hour as hour, {rd('value', 4, 'predicted')}, {rd('value + q10 * sqrt(ceil(h / 24.0))', 4, 'lower')}, {rd('value + q90 * sqrt(ceil(h / 24.0))', 4, 'upper')}
from q cross join (select unnest(range(1, 49)) as h) join tail using (event_type) where place = (h - 1) % 24 + 1""")
def _forecast_seasonal(t: Tables):
    out = series.forecast(hourly(t).drop("n"), "hour", "value", 48, ["event_type"], season=24, step=3600)
    return rounded(out.filter("data_type = 'forecast'").select("event_type", "hour", "predicted", "lower", "upper"), 4)


@query("forecast_metrics", f"""
with {HOURLY}, o as (select *, row_number() over (partition by event_type order by hour) as rn, floor(0.8 * count(*) over (partition by event_type)) as cut from hourly),
ends as (select event_type, max(value) filter (rn = cut) as last, (max(value) filter (rn = cut) - max(value) filter (rn = 1)) / (any_value(cut) - 1) as slope from o group by event_type),
s as (select o.event_type, value as y, last + (rn - cut) * slope as p from o join ends using (event_type) where rn > cut)
select event_type, count(*) as test_size, {rd('avg(abs(y - p))', 4, 'mae')}, {rd('avg((y - p) ** 2)', 4, 'mse')}, {rd('sqrt(avg((y - p) ** 2))', 4, 'rmse')},
  case when min(y) > 0 then {rd('avg(abs((y - p) / y)) * 100', 4)} end as mape from s group by event_type""")
def _forecast_metrics(t: Tables):
    return rounded(series.holdout_metrics(hourly(t).drop("n"), "hour", "value", ["event_type"]), 4)


@query("label_encode", """
with l as (select p_type, cast(row_number() over (order by p_type) - 1 as int) as code from (select distinct p_type from part))
select p_partkey, p_type, code as p_type_code from part join l using (p_type)""")
def _label_encode(t: Tables):
    return label_encode(t.part.select("p_partkey", "p_type"), ["p_type"])
