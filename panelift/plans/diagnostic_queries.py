"""Fit statistics, residual tests, validation, collinearity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators import collinearity, linear, validation
from panelift.operators.correlation import correlation_matrix, correlation_with_target
from panelift.plans.catalog import Tables, query, rd, rounded
from panelift.plans.model_queries import FEATURES, LINE_OLS, line_fit
from panelift.plans.profile_queries import CORR_ROWS, corr_rows
from panelift.plans.shared import GEO, VISITS, geo_orders, two_feature_ols, visits
from panelift.session import spill

RESIDUAL = f"{LINE_OLS}, res as (select *, b0 + b1 * l_quantity + b2 * l_discount as fitted, l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount) as residual from lineitem, beta)"
CENTRED = "mom as (select count(*) as n, avg(residual) as mu, avg((residual - mm) ** 2) as m2, avg((residual - mm) ** 3) as m3, avg((residual - mm) ** 4) as m4 from res, (select avg(residual) as mm from res))"


def scored(t: Tables) -> DataFrame:
    return linear.residuals(t.lineitem, line_fit(t))


@query("ols_summary", f"""
with {LINE_OLS}, s as (select n, 1 - sse / sst as r2, sse, sst, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) as llf from beta)
select n as observations, {rd('r2', 10, 'r_squared')}, {rd('1 - (1 - r2) * (n - 1) / (n - 3)', 10, 'adjusted_r_squared')}, {rd('((sst - sse) / 2) / (sse / (n - 3))', 6, 'f_statistic')},
  -- with two numerator degrees of freedom the upper tail has a closed form
  {rd('(1 + (sst - sse) / sse) ** (-(n - 3) / 2.0)', 8, 'f_pvalue')}, {rd('llf', 3, 'log_likelihood')}, {rd('6 - 2 * llf', 3, 'aic')}, {rd('3 * ln(n) - 2 * llf', 3, 'bic')} from s""")
def _ols_summary(t: Tables):
    out = rounded(linear.ols_summary(t.spark, line_fit(t)), 8, "f_pvalue")
    return rounded(rounded(rounded(out, 10, "r_squared", "adjusted_r_squared"), 6, "f_statistic"), 3, "log_likelihood", "aic", "bic")


@query("ols_inference")
def _ols_inference(t: Tables):
    return linear.inference(t.spark, line_fit(t))


@query("ols_errors", f"""
with {LINE_OLS}, s as (select *, sse / (n - 3) as s2, s11 * s22 - s12 * s12 as d from beta),
e as (select 'intercept' as term, b0 as b, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * d))) as se from s
  union all select 'l_quantity', b1, sqrt(s2 * s22 / (n * d)) from s union all select 'l_discount', b2, sqrt(s2 * s11 / (n * d)) from s)
select term, {rd('se', 5, 'std_error')}, {rd('b / se', 5, 't_value')} from e""")
def _ols_errors(t: Tables):
    return rounded(linear.inference(t.spark, line_fit(t)).select("term", "std_error", "t_value"), 5)


@query("jarque_bera", f"""
with {RESIDUAL}, {CENTRED}, j as (select n, m3 / m2 ** 1.5 as s, m4 / m2 ** 2 - 3 as k from mom)
select n, {rd('s', 6, 'skewness')}, {rd('k', 6, 'kurtosis')}, {rd('n / 6.0 * (s ** 2 + k ** 2 / 4)', 3, 'statistic')}, {rd('exp(-n / 12.0 * (s ** 2 + k ** 2 / 4))', 8, 'p_value')}, exp(-n / 12.0 * (s ** 2 + k ** 2 / 4)) > 0.05 as normal from j""")
def _jarque_bera(t: Tables):
    return rounded(rounded(rounded(linear.jarque_bera(scored(t)), 6, "skewness", "kurtosis"), 3, "statistic"), 8, "p_value")


@query("residual_summary", f"""
with {RESIDUAL}, {CENTRED}, g as (select n, m3 / m2 ** 1.5 as g1, m4 / m2 ** 2 - 3 as g2 from mom),
r as (select count(*) as count, avg(residual) as mean, stddev_samp(residual) as std, min(residual) as min, max(residual) as max from res)
select count, {rd('mean', 3, 'mean')}, {rd('std', 4, 'std')}, {rd('min', 4, 'min')}, {rd('max', 4, 'max')}, {rd('sqrt(n * (n - 1.0)) / (n - 2) * g1', 6, 'skewness')},
  {rd('(n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6)', 6, 'kurtosis')} from r, g""")
def _residual_summary(t: Tables):
    return rounded(rounded(rounded(linear.residual_summary(scored(t)), 6, "skewness", "kurtosis"), 3, "mean"), 4, "std", "min", "max")


@query("residual_outliers", f"""
with {VISITS}, {two_feature_ols('visits', 'sales', 'visits', 'week')}, res as (select sales - (b0 + b1 * visits + b2 * week) as r from visits, beta), s as (select stddev_samp(r) as sd from res)
select count(*) filter (abs(r / sd) > 2) as beyond_2, count(*) filter (abs(r / sd) > 3) as beyond_3 from res, s""")
def _residual_outliers(t: Tables):
    rows = spill(visits(t), "visits")
    return linear.residual_outliers(linear.residuals(rows, linear.fit_ols(rows, "sales", ["visits", "week"])))


@query("first_outliers", f"""
with {VISITS}, {two_feature_ols('visits', 'sales', 'visits', 'week')}, res as (select city, year, week, sales - (b0 + b1 * visits + b2 * week) as r from visits, beta),
s as (select stddev_samp(r) as sd from res), p as (select row_number() over (order by year, week, city) - 1 as position, r / sd as z from res, s)
select position, {rd('z', 5, 'standardized_residual')} from p where abs(z) > 2 order by position limit 10""")
def _first_outliers(t: Tables):
    rows = spill(visits(t), "visits")
    fitted = linear.residuals(rows, linear.fit_ols(rows, "sales", ["visits", "week"]))
    return rounded(linear.first_outliers(fitted, ["year", "week", "city"]), 5)


@query("durbin_watson", f"""
with {RESIDUAL}, o as (select residual, lag(residual) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as p from res),
d as (select sum((residual - p) ** 2) / sum(residual ** 2) as dw from o)
select {rd('dw', 6, 'durbin_watson')}, dw not between 1.5 and 2.5 as autocorrelated,
  case when dw < 1.5 then 'positive autocorrelation likely' when dw > 2.5 then 'negative autocorrelation likely' else 'no strong evidence of autocorrelation' end as reading from d""")
def _durbin_watson(t: Tables):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rounded(linear.durbin_watson(scored(t), order), 6)


@query("fit_metrics", f"""
with {RESIDUAL}, r as (select l_returnflag, count(*) as n, avg(abs(residual)) as mae, avg(residual ** 2) as mse, var_pop(l_extendedprice) as v, min(l_extendedprice) as lo, avg(abs(residual / l_extendedprice)) * 100 as mape from res group by l_returnflag)
select l_returnflag, n as observations, {rd('1 - mse / v', 8, 'r_squared')}, {rd('1 - mse / v * (n - 1) / (n - 3)', 8, 'adjusted_r_squared')}, {rd('mae', 4, 'mae')}, {rd('mse', 0, 'mse')}, {rd('sqrt(mse)', 4, 'rmse')},
  case when lo > 0 then {rd('mape', 6)} end as mape, {rd('greatest(0, 1 - mse / v)', 8, 'accuracy')} from r""")
def _fit_metrics(t: Tables):
    out = linear.fit_metrics(scored(t), "l_extendedprice", "fitted", 2, ["l_returnflag"])
    return rounded(rounded(rounded(rounded(out, 8, "r_squared", "adjusted_r_squared", "accuracy"), 4, "mae", "rmse"), 0, "mse"), 6, "mape")


@query("actual_vs_predicted", f"""
with {VISITS}, {two_feature_ols('visits', 'sales', 'visits', 'week')}
select city, year, week, {rd('sales', 2, 'actual')}, {rd('b0 + b1 * visits + b2 * week', 2, 'predicted')} from visits, beta""")
def _actual_vs_predicted(t: Tables):
    rows = spill(visits(t), "visits")
    predictions = linear.predict(rows, linear.fit_ols(rows, "sales", ["visits", "week"]), "predicted").select("city", "year", "week", "predicted")
    joined = rows.select("city", "year", "week", F.col("sales").alias("actual")).join(predictions, ["city", "year", "week"])
    return rounded(joined, 2, "actual", "predicted")


@query("prediction_segments", f"""
with {VISITS}, n as (select *, lead(sales) over w as na, lead(promo_sales * 5) over w as np, promo_sales * 5 as p from visits window w as (partition by city order by year, week))
select city, year, week, case when p > sales and np > na then 'over' when sales > p and na > np then 'under' when p + np > sales + na then 'over' else 'under' end as segment from n where na is not null""")
def _prediction_segments(t: Tables):
    rows = visits(t).select("city", "year", "week", "sales", (F.col("promo_sales") * 5).alias("guess"))
    return linear.segments(rows, "sales", "guess", ["year", "week"], ["city"]).select("city", "year", "week", "segment")


@query("importance_linear", f"""
with {LINE_OLS}, s as (select *, sse / (n - 3) as s2, s11 * s22 - s12 * s12 as d from beta),
e as (select 'l_quantity' as feature, b1 as b, b1 / sqrt(s2 * s22 / (n * d)) as t, b1 * sqrt(s11 / syy) as z from s union all select 'l_discount', b2, b2 / sqrt(s2 * s11 / (n * d)), b2 * sqrt(s22 / syy) from s)
select feature, {rd('b', 4, 'coefficient')}, {rd('abs(b)', 4, 'abs_coefficient')}, {rd('t', 5, 't_value')}, {rd('z', 8, 'standardized_coefficient')},
  case when b > 0 then 'positive_driver' else 'negative_driver' end as direction, cast(row_number() over (order by abs(z) desc) as int) as importance_rank from e""")
def _importance_linear(t: Tables):
    out = linear.importance_linear(t.lineitem, "l_extendedprice", FEATURES).drop("p_value", "stars")
    return rounded(rounded(rounded(out, 4, "coefficient", "abs_coefficient"), 5, "t_value"), 8, "standardized_coefficient")


@query("importance_rank", """
with c as (select p_type, avg(p_retailprice) - (select avg(p_retailprice) from part) as lift from part group by p_type)
select p_type as feature, round(lift, 6) + 0.0 as lift, cast(row_number() over (order by abs(lift) desc, p_type) as int) as importance_rank from c qualify row_number() over (order by abs(lift) desc, p_type) <= 5""")
def _importance_rank(t: Tables):
    whole = t.part.agg(F.avg("p_retailprice")).first()[0]
    lifts = t.part.groupBy(F.col("p_type").alias("feature")).agg((F.avg("p_retailprice") - F.lit(whole)).alias("lift"))
    return rounded(linear.ranked(lifts, F.col("lift"), "feature", 5), 6)


FOLDS = f"""rows5 as (select *, l_orderkey % 5 as fold from lineitem),
train as (select f.fold as held, l.* exclude (fold) from rows5 l join (select unnest(range(0, 5)) as fold) f on l.fold <> f.fold),
{two_feature_ols('train', 'l_extendedprice', 'l_quantity', 'l_discount', 'held')},
test as (select fold, l_extendedprice as y, b0 + b1 * l_quantity + b2 * l_discount as p from rows5 join beta on fold = held),
score as (select fold, count(*) as observations, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) as r2, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae from test group by fold)"""


@query("cross_validation", f"with {FOLDS} select fold, observations, {rd('r2', 8, 'r2')}, {rd('rmse', 4, 'rmse')}, {rd('mae', 4, 'mae')} from score")
def _cross_validation(t: Tables):
    rows = t.lineitem.withColumn("fold", F.col("l_orderkey") % 5)
    scores, _ = linear.cross_validation(rows, "l_extendedprice", FEATURES, "fold")
    return rounded(rounded(scores, 8, "r2"), 4, "rmse", "mae")


@query("cross_validation_summary", f"""
with {FOLDS} select count(*) as folds, {rd('avg(r2)', 8, 'r2_mean')}, {rd('stddev_pop(r2)', 8, 'r2_std')}, {rd('min(r2)', 8, 'r2_min')}, {rd('max(r2)', 8, 'r2_max')},
  {rd('sqrt(avg(rmse ** 2))', 4, 'rmse_mean')}, {rd('avg(mae)', 4, 'mae_mean')}, {rd('stddev_pop(mae)', 4, 'mae_std')}, stddev_pop(r2) < 0.1 as stable from score""")
def _cross_validation_summary(t: Tables):
    rows = t.lineitem.withColumn("fold", F.col("l_orderkey") % 5)
    _, summary = linear.cross_validation(rows, "l_extendedprice", FEATURES, "fold")
    return rounded(rounded(summary.drop("r2_variation"), 8, "r2_mean", "r2_std", "r2_min", "r2_max"), 4, "rmse_mean", "mae_mean", "mae_std")


@query("train_test_split", "select o_orderkey, case when o_orderkey % 5 = 0 then 'test' else 'train' end as split from orders")
def _train_test_split(t: Tables):
    return validation.modulo_split(t.orders.select("o_orderkey"), "o_orderkey")


def split_rows(t: Tables) -> DataFrame:
    return validation.modulo_split(t.lineitem, "l_orderkey")


BASE = f"""rows as (select *, case when l_orderkey % 5 = 0 then 'test' else 'train' end as split from lineitem), fitrows as (select * from rows where split = 'train'),
{two_feature_ols('fitrows', 'l_extendedprice', 'l_quantity', 'l_discount')}, s as (select l_returnflag, split, l_extendedprice as y, b0 + b1 * l_quantity + b2 * l_discount as p from rows, beta),
a as (select l_returnflag, split, count(*) as n, avg(abs(y - p)) as mae, avg((y - p) ** 2) as mse, 1 - avg((y - p) ** 2) / var_pop(y) as r2 from s group by l_returnflag, split),
metrics as (select tr.l_returnflag, 'linear' as model, tr.r2 as train_r2, te.r2 as test_r2, 1 - (1 - tr.r2) * (tr.n - 1) / (tr.n - 3) as train_adj_r2, tr.mae as train_mae, te.mae as test_mae, sqrt(tr.mse) as train_rmse,
  sqrt(te.mse) as test_rmse, tr.r2 - te.r2 as r2_difference, te.mae / tr.mae as mae_ratio, case when tr.r2 > 0 then te.r2 / tr.r2 else 0 end as generalization
  from a tr join a te on tr.l_returnflag = te.l_returnflag and tr.split = 'train' and te.split = 'test')"""


@query("baseline_linear", f"with {BASE} select l_returnflag, model, " + ", ".join([rd(c, 8, c) for c in ("train_r2", "test_r2", "train_adj_r2", "r2_difference", "mae_ratio")] + [rd(c, 4, c) for c in ("train_mae", "test_mae", "train_rmse", "test_rmse")]) + ", " + rd("generalization", 2, "generalization") + " from metrics")
def _baseline_linear(t: Tables):
    out = validation.baseline_linear(split_rows(t), "l_extendedprice", FEATURES, segment=["l_returnflag"])
    return rounded(rounded(rounded(out, 8, "train_r2", "test_r2", "train_adj_r2", "r2_difference", "mae_ratio"), 4, "train_mae", "test_mae", "train_rmse", "test_rmse"), 2, "generalization")


# Metric tables with a row per (segment, model): three simple predictors of the price, per brand.
GUESS = f"""guess as (select p_brand, l_orderkey % 5 = 0 as test, l_extendedprice as y, p_retailprice * l_quantity as a, p_retailprice * l_quantity * (1 + l_tax) as b, 20000.0 + 1000 * l_quantity as c
  from lineitem join part on l_partkey = p_partkey),
long as (select p_brand, test, y, 'exact' as model, a as p from guess union all select p_brand, test, y, 'taxed', b from guess union all select p_brand, test, y, 'rule', c from guess),
agg as (select p_brand, model, test, count(*) as n, avg(abs(y - p)) as mae, 1 - avg((y - p) ** 2) / var_pop(y) as r2 from long group by all),
gm as (select tr.p_brand, tr.model, tr.r2 as train_r2, te.r2 as test_r2, tr.r2 - te.r2 as r2_difference, te.mae / tr.mae as mae_ratio, te.mae as test_mae
  from agg tr join agg te on tr.p_brand = te.p_brand and tr.model = te.model and not tr.test and te.test)"""


def guess_metrics(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    exact = F.col("p_retailprice") * F.col("l_quantity")
    wide = rows.select(
        "p_brand", "l_orderkey", "l_extendedprice", exact.alias("a"), (exact * (1 + F.col("l_tax"))).alias("b"), (F.lit(20000.0) + 1000 * F.col("l_quantity")).alias("c")
    )
    return validation.split_metrics(validation.modulo_split(wide, "l_orderkey"), "l_extendedprice", {"exact": "a", "taxed": "b", "rule": "c"}, 2, segment=["p_brand"])


@query("baseline_overview", f"""
with {GUESS} select p_brand, arg_max(model, test_r2) as best_model, {rd('max(test_r2)', 6, 'best_test_r2')}, {rd('min(test_r2)', 6, 'worst_test_r2')}, {rd('avg(test_r2)', 6, 'average_test_r2')}, {rd('stddev_pop(test_r2)', 6, 'std_test_r2')},
  {rd('avg(r2_difference)', 6, 'mean_r2_difference')}, {rd('min(test_mae)', 3, 'best_test_mae')}, {rd('max(test_mae)', 3, 'worst_test_mae')}, {rd('avg(test_mae)', 3, 'average_test_mae')}, count(*) as model_count from gm group by p_brand""")
def _baseline_overview(t: Tables):
    out = validation.baseline_overview(guess_metrics(t), ["p_brand"])
    return rounded(rounded(out, 3, "best_test_mae", "worst_test_mae", "average_test_mae"), 6, "best_test_r2", "worst_test_r2", "average_test_r2", "std_test_r2", "mean_r2_difference")


@query("baseline_rank", f"""
with {GUESS}, cur as (select p_brand, 1 - avg((y - c) ** 2) / var_pop(y) as r2 from guess group by p_brand),
b as (select p_brand, r2, count(*) filter (r2 > test_r2) as w, count(*) as t from cur join gm using (p_brand) group by p_brand, r2)
select p_brand, {rd('r2', 6, 'r2')}, w as better_than, t as total_baselines, {rd('w * 100.0 / t', 4, 'better_percent')},
  case when w = t then 'best' when w >= t * 0.7 then 'above_average' when w >= t * 0.3 then 'average' else 'below_average' end as ranking from b""")
def _baseline_rank(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("c", F.lit(20000.0) + 1000 * F.col("l_quantity"))
    current = linear.fit_metrics(rows, "l_extendedprice", "c", 2, ["p_brand"]).select("p_brand", F.col("r_squared").alias("r2"))
    return rounded(rounded(validation.baseline_rank(current, guess_metrics(t), ["p_brand"]), 6, "r2"), 4, "better_percent")


ALERTS = f"""{GUESS}, alerts as (
  select p_brand, model, 'high_r2_difference' as alert, case when r2_difference > 0.2 then 'high' else 'medium' end as severity from gm where r2_difference > 0.01
  union all select p_brand, model, 'high_mae_ratio', case when mae_ratio > 2 then 'high' else 'medium' end from gm where mae_ratio > 1.05
  union all select p_brand, model, 'suspicious_train_fit', 'high' from gm where train_r2 > 0.95 and test_r2 < 0.8)"""


@query("overfitting_alerts", f"with {ALERTS} select * from alerts")
def _overfitting_alerts(t: Tables):
    return validation.overfitting_alerts(guess_metrics(t), 0.01, 1.05, ["p_brand"])


@query("overall_risk", f"""
with {ALERTS}, c as (select p_brand, count(*) filter (severity = 'high') as h, count(distinct model) as m from alerts group by p_brand)
select p_brand, coalesce(h, 0) as high_alerts, coalesce(m, 0) as models_with_alerts, case when h >= 2 then 'high' when h >= 1 or m >= 2 then 'medium' else 'low' end as risk
from (select distinct p_brand from gm) left join c using (p_brand)""")
def _overall_risk(t: Tables):
    metrics = guess_metrics(t)
    return validation.overall_risk(validation.overfitting_alerts(metrics, 0.01, 1.05, ["p_brand"]), metrics, ["p_brand"])


@query("overfitting_risk", f"""
with {BASE} select model, {rd('train_r2', 8, 'train_r2')}, {rd('test_r2', 8, 'test_r2')}, {rd('r2_difference', 8, 'r2_difference')}, {rd('mae_ratio', 6, 'mae_ratio')}, {rd('generalization', 2, 'generalization')},
  case when r2_difference > 0.2 or mae_ratio > 1.5 or (train_r2 > 0.95 and test_r2 < 0.7) then 'high' when r2_difference > 0.1 then 'medium' else 'low' end as risk,
  concat_ws(',', case when r2_difference > 0.2 then 'large_r2_difference' when r2_difference > 0.1 then 'moderate_r2_difference' end, case when mae_ratio > 1.5 then 'high_mae_ratio' end,
    case when train_r2 > 0.95 and test_r2 < 0.7 then 'suspicious_train_fit' end) as factors, {rd('2.0 / (select count(*) from rows)', 10, 'feature_ratio')}, l_returnflag from metrics""")
def _overfitting_risk(t: Tables):
    rows = split_rows(t)
    metrics = validation.baseline_linear(rows, "l_extendedprice", FEATURES, segment=["l_returnflag"])
    count = rows.count()
    out = validation.overfitting_risk(metrics, len(FEATURES), F.lit(float(count)), ["l_returnflag"])
    return rounded(rounded(rounded(rounded(out, 8, "train_r2", "test_r2", "r2_difference"), 6, "mae_ratio"), 2, "generalization"), 10, "feature_ratio")


@query("performance_grade", f"""
with {GUESS} select p_brand, model, case when test_r2 > 0.8 and r2_difference < 0.1 and mae_ratio < 1.2 then 'excellent' when test_r2 > 0.6 and r2_difference < 0.15 and mae_ratio < 1.3 then 'good'
  when test_r2 > 0.3 and r2_difference < 0.2 and mae_ratio < 1.5 then 'fair' when test_r2 > 0.1 then 'poor' else 'very_poor' end as grade from gm""")
def _performance_grade(t: Tables):
    return validation.graded(guess_metrics(t)).select("p_brand", "model", "grade")


COL3 = ["l_quantity", "l_discount", "net"]
TARGET = "l_extendedprice"


def _vif_sql() -> str:
    """VIF of three columns from their correlation matrix (closed form of the inverse's diagonal)."""
    return f"""{CORR_ROWS}, r as (select corr(l_quantity, l_discount) as a, corr(l_quantity, net) as b, corr(l_discount, net) as c from c),
d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as d from r),
vif as (select 'l_quantity' as variable, (1 - c * c) / d as vif from d union all select 'l_discount', (1 - b * b) / d from d union all select 'net', (1 - a * a) / d from d)"""


def vifs(t: Tables, threshold: float = 10.0) -> DataFrame:
    return collinearity.vif(corr_rows(t), COL3, threshold)


@query("vif", f"with {_vif_sql()} select variable, {rd('vif', 6, 'vif')}, vif > 10 as high from vif")
def _vif(t: Tables):
    return rounded(vifs(t), 6)


LEVEL = "case when vif > 10 then 'severe' when vif > 5 then 'moderate' else 'acceptable' end"


@query("vif_bands", f"""
with {_vif_sql()} select variable, {rd('vif', 6, 'vif')}, {LEVEL} as level, case when vif > 50 then 'severe' when vif > 10 then 'high' when vif > 5 then 'moderate' else 'acceptable' end as category, vif > 5 as concern,
  case when vif > 10 then 'consider_removal' when vif > 5 then 'monitor' else 'keep' end as advice from vif""")
def _vif_bands(t: Tables):
    return rounded(collinearity.vif_bands(vifs(t)), 6)


@query("vif_wide")
def _vif_wide(t: Tables):
    """Sixteen columns: the partition-wise matrix path, with exact linear dependence."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = t.lineitem.select(
        q, d, "l_tax", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", (q + d).alias("sum_qd"), (q * q).alias("q2"), (q * d).alias("qd"), F.sqrt(q).alias("root"),
        F.month("l_shipdate").alias("month"), F.year("l_shipdate").alias("year"), F.dayofmonth("l_shipdate").alias("day"), F.log1p(q).alias("logq"), (F.col("l_orderkey") % 10).alias("digit"),
    )
    return collinearity.vif(rows, rows.columns)


ALL4 = ["l_quantity", "l_extendedprice", "l_discount", "net", "twice"]
PAIR_ROWS = "c as (select l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) as net, l_quantity * 2 + l_tax as twice from lineitem)"
PAIR_TIDY = "tidy as (" + " union all ".join(f"select {i} as i, {j} as j, '{a}' as var_i, '{b}' as var_j, corr({a}, {b}) as corr from c" for i, a in enumerate(ALL4) for j, b in enumerate(ALL4)) + ")"
PAIRS = f"""{PAIR_ROWS}, {PAIR_TIDY}, tt as (select var_i as v, abs(corr) as t from tidy where var_j = 'l_extendedprice'),
pairs as (select var_i as variable_1, var_j as variable_2, corr as correlation, abs(corr) as abs_correlation, x.t as target_corr_i, y.t as target_corr_j,
  case when x.t > y.t then var_i else var_j end as keep, case when x.t > y.t then var_j else var_i end as remove
  from tidy join tt x on x.v = var_i join tt y on y.v = var_j where i < j and abs(corr) > 0.8)"""


def pair_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice")
    )


def pairs_of(t: Tables, include_target: bool = True):
    matrix = spill(correlation_matrix(pair_rows(t), ALL4), "matrix")
    return matrix, collinearity.high_pairs(matrix, TARGET, include_target=include_target)


@query("high_correlation_pairs", f"with {PAIRS} select variable_1, variable_2, " + ", ".join(rd(c, 6, c) for c in ("correlation", "abs_correlation", "target_corr_i", "target_corr_j")) + ", keep, remove from pairs")
def _high_correlation_pairs(t: Tables):
    return rounded(pairs_of(t)[1], 6).orderBy(F.desc("abs_correlation"), "variable_1", "variable_2")


@query("correlation_bands", f"""
with {PAIRS} select count(*) as total_pairs, count(*) filter (abs_correlation >= 0.99) as perfect, count(*) filter (abs_correlation >= 0.95 and abs_correlation < 0.99) as very_high,
  count(*) filter (abs_correlation >= 0.8 and abs_correlation < 0.95) as high from pairs""")
def _correlation_bands(t: Tables):
    return collinearity.correlation_bands(pairs_of(t)[1])


# VIF of the four features by regression of each on the others, as the inverse correlation matrix of
# two independent pairs is not closed here: quantity and twice are nearly the same variable.
REMOVALS = f"""{PAIRS}, vf as (select 1 / (1 - corr(l_quantity, twice) ** 2) > 10 as high_pair from c),
rem as (select v as variable, bool_or(byc) as by_correlation, bool_or(byv) as by_vif from (
  select remove as v, true as byc, false as byv from pairs where variable_1 <> 'l_extendedprice' and variable_2 <> 'l_extendedprice'
  union all select unnest(['l_quantity', 'twice']), false, true from vf where high_pair) group by v)"""


def removals_of(t: Tables):
    matrix, pairs = pairs_of(t, include_target=False)
    vif_table = spill(collinearity.vif(pair_rows(t), [c for c in ALL4 if c != TARGET]), "vif")
    return matrix, pairs, vif_table, collinearity.removal_breakdown(pairs, vif_table, TARGET)


@query("removal_breakdown", f"with {REMOVALS} select variable, by_correlation, by_vif, by_correlation and by_vif as both from rem")
def _removal_breakdown(t: Tables):
    return removals_of(t)[3]


NAMES = "(select unnest([" + ", ".join(f"'{c}'" for c in ALL4) + "]) as variable)"


@query("feature_reduction", f"""
with {REMOVALS} select variable, case when variable in (select variable from rem) then 'remove' else 'keep' end as decision, {rd('(select count(*) from rem) * 100.0 / 5', 4, 'reduction_percent')} from {NAMES}""")
def _feature_reduction(t: Tables):
    return rounded(collinearity.feature_reduction(ALL4, TARGET, removals_of(t)[3]), 4)


@query("reduced_dataset", "select l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) as net from lineitem")
def _reduced_dataset(t: Tables):
    decisions = collinearity.feature_reduction(ALL4, TARGET, removals_of(t)[3])
    return collinearity.reduced_dataset(pair_rows(t), decisions)


@query("variable_ranking", f"""
with {_vif_sql()}, s as (select variable, abs(k.r) as tc, least(vif, 100.0) as v from vif join (
  select 'l_quantity' as variable, corr(l_quantity, l_extendedprice) as r from c union all select 'l_discount', corr(l_discount, l_extendedprice) from c union all select 'net', corr(net, l_extendedprice) from c) k using (variable))
select variable, {rd('tc', 6, 'target_corr')}, {rd('v', 6, 'vif')}, {rd('tc * 100 - v / 10', 6, 'score')}, 'keep' as action, cast(row_number() over (order by tc * 100 - v / 10 desc) as int) as rank from s""")
def _variable_ranking(t: Tables):
    rows = corr_rows(t)
    matrix = spill(correlation_matrix(rows, [*COL3, TARGET]), "matrix")
    table = vifs(t)
    gone = collinearity.removal_breakdown(collinearity.high_pairs(matrix, TARGET), table, TARGET)
    return rounded(collinearity.variable_ranking(correlation_with_target(matrix, TARGET), table, gone), 6)


@query("multicollinearity_severity", f"""
with {REMOVALS}, k as (select (select count(*) from pairs where variable_1 <> 'l_extendedprice' and variable_2 <> 'l_extendedprice') as p, (select 2 * count(*) filter (high_pair) from vf) as v, (select count(*) from rem) as r)
select p as high_pairs, cast(v as bigint) as high_vif, r as removals,
  case when r * 20.0 > 80 or p > 100 then 'critical' when r * 20.0 > 50 or p > 50 then 'high' when r * 20.0 > 20 or p > 20 then 'medium' else 'low' end as severity_by_share,
  case when r > 10 or p > 50 or v > 10 then 'critical' when r > 5 or p > 20 or v > 5 then 'high' when r > 2 or p > 10 or v > 2 then 'medium' else 'low' end as severity_by_count from k""")
def _multicollinearity_severity(t: Tables):
    _, pairs, table, gone = removals_of(t)
    return collinearity.severity(pairs, table, gone, len(ALL4))


@query("prediction_summary", f"""
with {GEO}, p as (select city as model, o_totalprice * 0.9 + c_acctbal as prediction from geo)
select model, count(*) as total_predictions, {rd('avg(prediction)', 3, 'mean')}, {rd('stddev_samp(prediction)', 3, 'std')}, {rd('min(prediction)', 3, 'min')}, {rd('max(prediction)', 3, 'max')} from p group by model""")
def _prediction_summary(t: Tables):
    from panelift.operators.kpi import prediction_summary

    rows = geo_orders(t).select(F.col("city").alias("model"), (F.col("o_totalprice") * 0.9 + F.col("c_acctbal")).alias("prediction"))
    return rounded(prediction_summary(rows, "prediction"), 3)
