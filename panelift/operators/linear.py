"""Linear regression: fit, inference, contributions and residual diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelift.functions.tails import f_upper, t_quantile, t_two_sided
from panelift.operators.gram import (
    LinearFit,
    Moments,
    holdout_errors,
    information_criteria,
    moments,
    moments_by,
    moments_frame,
    solve_linear,
)
from panelift.operators.ordered import add_lags, slice_rows
from panelift.session import spill

SIGNIFICANCE = 0.05
MAX_LAG = 7
DW_LOW, DW_HIGH = 1.5, 2.5
STABLE_STD = 0.1


def fit_ols(df: DataFrame, target: str, features: Sequence[str], missing: str = "raise") -> LinearFit:
    """Least squares in one pass. Rows with gaps stop the fit, or are left out with missing='drop'."""
    if not features:
        raise ValueError("at least one feature is needed")
    m = moments(df, [*features, target])
    if missing == "raise" and m.total > m.n:
        raise ValueError(f"{int(m.total - m.n)} rows have missing values; repair them or pass missing='drop'")
    return solve_linear(m, target, features)


def _number(value: float) -> float | None:
    return None if value is None or np.isnan(value) else float(value)


def coefficients(spark, fit: LinearFit) -> DataFrame:
    """(position, term, coefficient), the intercept first."""
    rows = [(i, t, float(c)) for i, (t, c) in enumerate(zip(fit.terms, fit.coefficients))]
    return spark.createDataFrame(rows, "position int, term string, coefficient double")


def linear_expression(fit: LinearFit, intercept: bool = True) -> Column:
    out = F.lit(fit.intercept if intercept else 0.0)
    for c, b in zip(fit.features, fit.slopes):
        out = out + F.col(c) * F.lit(float(b))
    return out


def predict(df: DataFrame, fit: LinearFit, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, linear_expression(fit))


def contributions(df: DataFrame, fit: LinearFit, keep: Sequence[str]) -> DataFrame:
    """Long (keep..., feature, value, contribution); the intercept is left out."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in fit.features])
    long = wide.unpivot(list(keep), list(fit.features), "feature", "value")
    slope = F.lit(None).cast("double")
    for c, b in zip(fit.features, fit.slopes):
        slope = F.when(F.col("feature") == c, F.lit(float(b))).otherwise(slope)
    return long.withColumn("contribution", F.col("value") * slope)


def contribution_summary(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Per feature: coefficient, total, mean, std, min, max and elasticity at the means."""
    y = F.avg(fit.target)
    structs = []
    for c, b in zip(fit.features, fit.slopes):
        share = F.col(c) * F.lit(float(b))
        elasticity = F.when(y != 0, F.lit(float(b)) * F.try_divide(F.avg(c), y)).otherwise(0.0)
        structs.append(
            F.struct(
                F.lit(c).alias("feature"), F.lit(float(b)).alias("coefficient"), F.sum(share).alias("total"),
                F.avg(share).alias("mean"), F.stddev_samp(share).alias("std"), F.min(share).alias("min"),
                F.max(share).alias("max"), elasticity.alias("elasticity"),
                F.lit("increases" if b > 0 else "decreases").alias("direction"),
            )
        )
    packed = df.agg(*[s.alias(f"_s{i}") for i, s in enumerate(structs)])
    return packed.select(F.inline(F.array(*[f"_s{i}" for i in range(len(structs))])))


def stars(p: float | None) -> str:
    if p is None:
        return ""
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def inference_rows(fit: LinearFit) -> list[tuple]:
    """(term, coefficient, std_error, t, p, low, high, significant, stars, direction) per term."""
    rows = []
    errors = fit.standard_errors
    reach = t_quantile(1 - SIGNIFICANCE / 2, fit.df_resid) if fit.df_resid > 0 else float("nan")
    for term, b, se in zip(fit.terms, fit.coefficients, errors):
        b, se = float(b), float(se)
        if np.isnan(se):
            t = p = low = high = None
        else:
            t = b / se if se > 0 else float("inf") * float(np.sign(b))
            p = t_two_sided(t, fit.df_resid)
            low, high = b - reach * se, b + reach * se
        rows.append(
            (term, b, _number(se), t, p, low, high, p is not None and p < SIGNIFICANCE, stars(p),
             "positive_effect" if b > 0 else "negative_effect")
        )
    return rows


INFERENCE = (
    "term string, coefficient double, std_error double, t_value double, p_value double, "
    "ci_low double, ci_high double, significant boolean, stars string, direction string"
)


def inference(spark, fit: LinearFit) -> DataFrame:
    """Standard errors, t, p and 95 % intervals; NULL where the features are dependent."""
    return spark.createDataFrame(inference_rows(fit), INFERENCE)


def ols_summary(spark, fit: LinearFit) -> DataFrame:
    """One row: n, R2, adjusted R2, F, its p-value, log-likelihood, AIC, BIC."""
    k = len(fit.features)
    llf, aic, bic = information_criteria(fit.n, fit.sse, k + 1)
    f = f_p = None
    if fit.df_resid > 0 and fit.sse > 0:
        f = (fit.sst - fit.sse) / k / (fit.sse / fit.df_resid)
        f_p = f_upper(f, k, fit.df_resid)
    row = (int(fit.n), _number(fit.r2), _number(fit.adjusted_r2), f, f_p, llf, aic, bic)
    return spark.createDataFrame(
        [row],
        "observations long, r_squared double, adjusted_r_squared double, f_statistic double, "
        "f_pvalue double, log_likelihood double, aic double, bic double",
    )


def residuals(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Frame with fitted value and residual."""
    return df.withColumn("fitted", linear_expression(fit)).withColumn("residual", F.col(fit.target) - F.col("fitted"))


def jarque_bera(df: DataFrame, residual: str = "residual") -> DataFrame:
    """n, skewness, excess kurtosis, statistic, p-value (chi-square with 2 df) and normality flag."""
    r = df.agg(
        F.count(residual).alias("n"), F.skewness(residual).alias("skewness"), F.kurtosis(residual).alias("kurtosis")
    )
    statistic = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    p = F.exp(-F.col("statistic") / 2)
    return r.withColumn("statistic", statistic).withColumn("p_value", p).withColumn("normal", F.col("p_value") > SIGNIFICANCE)


def residual_summary(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Count, mean, std, min, max and bias-corrected skewness and kurtosis."""
    r = df.agg(
        F.count(residual).alias("count"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"),
        F.min(residual).alias("min"), F.max(residual).alias("max"),
        F.skewness(residual).alias("_g1"), F.kurtosis(residual).alias("_g2"),
    )
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return r.select("count", "mean", "std", "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"))


def standardized_residuals(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Residual divided by the residuals' sample standard deviation."""
    std = df.agg(F.stddev_samp(residual)).first()[0]
    return df.withColumn("standardized_residual", F.try_divide(F.col(residual), F.lit(std)))


def residual_outliers(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Rows beyond 2 and 3 standard deviations."""
    size = F.abs("standardized_residual")
    return standardized_residuals(df, residual).agg(
        F.count_if(size > 2).alias("beyond_2"), F.count_if(size > 3).alias("beyond_3")
    )


def first_outliers(df: DataFrame, order_by: Sequence[str], limit: int = 10, residual: str = "residual") -> DataFrame:
    """Positions of the first rows beyond 2 standard deviations, in the given order."""
    scored = standardized_residuals(df, residual)
    placed = slice_rows(scored, order_by).numbered("position").filter(F.abs("standardized_residual") > 2)
    return placed.orderBy("position").limit(limit).select("position", "standardized_residual")


def durbin_watson(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), residual: str = "residual"
) -> DataFrame:
    """Squared successive differences over squared residuals, with its reading."""
    sliced = slice_rows(df.select(*dict.fromkeys([*partition_by, *order_by, residual])), order_by, partition_by)
    pairs = sliced.shifted({"_before": (residual, 1)})
    gap = F.col(residual) - F.col("_before")
    sums = pairs.agg(
        F.try_divide(F.sum(gap * gap), F.sum(F.col(residual) * F.col(residual))).alias("durbin_watson")
    )
    dw = F.col("durbin_watson")
    reading = (
        F.when(dw < DW_LOW, "positive autocorrelation likely").when(dw > DW_HIGH, "negative autocorrelation likely")
        .otherwise("no strong evidence of autocorrelation")
    )
    return sums.withColumn("autocorrelated", ~dw.between(DW_LOW, DW_HIGH)).withColumn("reading", reading)


def fit_metrics(
    df: DataFrame, actual: str, predicted: str, features: int, by: Sequence[str] = ()
) -> DataFrame:
    """R2, adjusted R2, MAE, MSE, RMSE and MAPE (only when all actual values are positive)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = df.filter(y.isNotNull() & p.isNotNull())
    e = y - p
    raw = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("_var"), F.min(y).alias("_min"),
        (F.avg(F.abs(F.try_divide(e, y))) * 100).alias("_mape"),
    )
    n = F.col("observations").cast("double")
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_var"))
    adjusted = F.when(n > features + 1, 1 - (1 - r2) * (n - 1) / (n - features - 1))
    return raw.select(
        *by, "observations", r2.alias("r_squared"), adjusted.alias("adjusted_r_squared"), "mae", "mse",
        F.sqrt("mse").alias("rmse"), F.when(F.col("_min") > 0, F.col("_mape")).alias("mape"),
        F.greatest(r2, F.lit(0.0)).alias("accuracy"),
    )


def segments(df: DataFrame, actual: str, predicted: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Pairs of neighbouring points marked 'over' or 'under' by both points, else by their middle."""
    sliced = slice_rows(df, order_by, partition_by)
    pairs = sliced.shifted({"_next_a": (actual, -1), "_next_p": (predicted, -1)}).filter(F.col("_next_a").isNotNull())
    a, p, na, np_ = F.col(actual), F.col(predicted), F.col("_next_a"), F.col("_next_p")
    kind = (
        F.when((p > a) & (np_ > na), "over").when((a > p) & (na > np_), "under")
        .when((p + np_) > (a + na), "over").otherwise("under")
    )
    return sliced.restore(pairs.withColumn("segment", kind)).drop("_next_a", "_next_p")


def distributed_lag(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_lag: int = MAX_LAG,
    drop_on_all: bool = False,
) -> tuple[LinearFit, DataFrame]:
    """Regression on lags 1..max_lag only. Returns the fit and the complete lagged rows."""
    lagged = add_lags(df, features, max_lag, order_by, partition_by)
    terms = [f"{c}_lag{k}" for k in range(1, max_lag + 1) for c in features]
    rows = lagged.na.drop(subset=None if drop_on_all else [target, *terms])
    return fit_ols(rows, target, terms, missing="drop"), rows


def max_lag_order(terms: DataFrame, term: str = "term") -> DataFrame:
    """Largest lag number found in term names."""
    found = F.regexp_extract(F.lower(term), r"lag[_\s]*(\d+)", 1)
    order = F.when(found != "", found.cast("int"))
    return terms.agg(F.coalesce(F.max(order), F.lit(0)).alias("max_lag"), F.count(order).alias("lag_terms"))


def lag_significance(table: DataFrame) -> DataFrame:
    """Lag terms of an inference table with p-value and flag."""
    return table.filter(F.lower("term").contains("lag")).select(
        "term", "p_value", (F.col("p_value") < SIGNIFICANCE).alias("significant")
    )


def cross_validation(df: DataFrame, target: str, features: Sequence[str], fold: str) -> tuple[DataFrame, DataFrame]:
    """(scores per fold, summary). All folds come from one pass of moments grouped by fold.

    The training moments of a fold are the total minus its own; each fold's fit is solved on the
    executors, next to its moments, and its coefficients are joined back to its rows, where the mean
    absolute error is taken. Only the total moments (k x k) reach the driver, whatever the number of folds.
    A null fold is a fold of its own.
    """
    columns = [*features, target]
    k = len(columns)
    per_fold = spill(moments_frame(df, columns, [fold]), "fold_moments")
    whole = _pooled(per_fold, columns)
    fold_type = dict(df.dtypes)[fold]
    schema = f"`{fold}` {fold_type}, observations long, r2 double, rmse double, _beta array<double>"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in part.iterrows():
            own = Moments(columns, float(r["n"]), np.asarray(r["mean"], float), np.asarray(r["cross"], float).reshape(k, k), float(r["total"]))
            if own.n <= 0:
                continue
            fit = solve_linear(whole.minus(own), target, features)
            sse, sst = holdout_errors(own, fit)
            out.append((r[fold], int(own.n), 1 - sse / sst if sst > 0 else float("nan"), (sse / own.n) ** 0.5, [fit.intercept, *map(float, fit.slopes)]))
        return pd.DataFrame(out, columns=[fold, "observations", "r2", "rmse", "_beta"])

    fits = spill(per_fold.groupBy(fold).applyInPandas(solve, schema), "folds")
    beta = F.col("_beta")
    score = beta[0]
    for i, c in enumerate(features):
        score = score + beta[i + 1] * F.col(c)
    coefficients = fits.select(F.col(fold).alias("_fold"), "_beta")
    used = df.na.drop(subset=columns).select(fold, *columns)
    joined = used.join(coefficients, used[fold].eqNullSafe(coefficients["_fold"]))
    absolute = joined.groupBy("_fold").agg(F.avg(F.abs(F.col(target) - score)).alias("mae"))
    scores = fits.join(absolute, fits[fold].eqNullSafe(absolute["_fold"]), "left").select(fold, "observations", "r2", "rmse", "mae")
    r2 = F.col("r2")
    summary = scores.agg(
        F.count(F.lit(1)).alias("folds"), F.avg(r2).alias("r2_mean"), F.stddev_pop(r2).alias("r2_std"), F.min(r2).alias("r2_min"),
        F.max(r2).alias("r2_max"), F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse_mean"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
        F.try_divide(F.stddev_pop(r2), F.avg(r2)).alias("r2_variation"), (F.stddev_pop(r2) < STABLE_STD).alias("stable"),
    )
    return scores, summary


def _pooled(parts: DataFrame, names: list[str]) -> Moments:
    """Moments of all rows from a table of moments per group (n, mean, cross, total): one row per group.

    cross = sum of the groups' cross products + sum of n_g (mean_g - mean)(mean_g - mean)'. Two small
    aggregations over that table; k means and k x k sums reach the driver.
    """
    k = len(names)
    head = parts.agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        *[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k)],
    ).first()
    n = float(head["n"] or 0.0)
    if n <= 0:
        return Moments(names, 0.0, np.zeros(k), np.zeros((k, k)), float(head["total"] or 0.0))
    mean = np.array([float(head[f"m{i}"]) / n for i in range(k)])
    gap = [F.col("mean")[i] - F.lit(float(mean[i])) for i in range(k)]
    sums = parts.agg(*[F.sum(F.col("cross")[i * k + j] + F.col("n") * gap[i] * gap[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    cross = np.array([[float(sums[f"c{i}_{j}"]) for j in range(k)] for i in range(k)])
    return Moments(names, n, mean, cross, float(head["total"] or 0.0))


def _plus(a: Moments, b: Moments) -> Moments:
    n = a.n + b.n
    gap = b.mean - a.mean
    return Moments(
        a.names, n, a.mean + gap * (b.n / n), a.cross + b.cross + np.outer(gap, gap) * (a.n * b.n / n), a.total + b.total
    )


def ranked(table: DataFrame, by: Column, tie: str, limit: int | None = None) -> DataFrame:
    """Rank by absolute value, largest first. The table has one row per feature."""
    out = table.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs(by)), F.asc(tie))))
    return out if limit is None else out.filter(F.col("importance_rank") <= limit)


def importance_linear(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Coefficient, t, p, standardized coefficient, rank and direction per feature, from one pass."""
    m = moments(df, [*features, target])
    fit = solve_linear(m, target, features)
    sd = np.sqrt(m.variance())
    rows = []
    for i, r in enumerate(inference_rows(fit)[1:]):
        size = float(r[1] * sd[i] / sd[-1]) if sd[-1] > 0 else None
        rows.append((r[0], r[1], abs(r[1]), r[3], r[4], r[8], size, "positive_driver" if r[1] > 0 else "negative_driver"))
    table = df.sparkSession.createDataFrame(
        rows,
        "feature string, coefficient double, abs_coefficient double, t_value double, p_value double, stars string, "
        "standardized_coefficient double, direction string",
    )
    return ranked(table, F.col("standardized_coefficient"), "feature")

