"""Model reports as one long table (section, item, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.causal import did_effect, did_effect_size, did_fit
from panelift.operators.correlation import correlation_matrix
from panelift.operators.collinearity import vif
from panelift.operators.design import cell_means, crosstab, did_balance
from panelift.operators.linear import (
    contribution_summary,
    fit_metrics,
    fit_ols,
    inference,
    jarque_bera,
    ols_summary,
    residual_summary,
    residuals,
)
from panelift.operators.missing import missing_summary
from panelift.operators.profiling import describe_full
from panelift.operators.trees import shap_importance


def section(df: DataFrame, name: str, item: str | None = None) -> DataFrame:
    """A wide small table as (section, item, metric, value); values are text, missing ones NULL."""
    label = F.col(item) if item else F.lit("all")
    values = [c for c in df.columns if c != item]
    slim = df.select(label.alias("item"), *[F.col(c).cast("string").alias(c) for c in values])
    long = slim.unpivot(["item"], values, "metric", "value")
    return long.select(F.lit(name).alias("section"), "item", "metric", "value")


def stack_sections(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linear_report(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Data-set overview, performance, diagnostics, residuals, contributions and collinearity of a linear model."""
    spark = df.sparkSession
    columns = [target, *features]
    rows = df.select(*columns).na.drop()
    fit = fit_ols(rows, target, features)
    scored = residuals(rows, fit)
    pairs = correlation_matrix(rows, columns).filter("i < j").select(F.concat_ws("|", "var_i", "var_j").alias("pair"), "corr")
    return stack_sections(
        [
            section(missing_summary(df, columns), "missing_data", "variable"),
            section(describe_full(df, columns), "descriptive_statistics", "variable"),
            section(fit_metrics(scored, target, "fitted", len(list(features))), "model_performance"),
            section(ols_summary(spark, fit), "model_diagnostics"),
            section(inference(spark, fit), "coefficients", "term"),
            section(residual_summary(scored), "residual_summary"),
            section(jarque_bera(scored), "normality"),
            section(contribution_summary(rows, fit), "contributions", "feature"),
            section(vif(rows, features), "variance_inflation", "variable"),
            section(pairs, "correlation", "pair"),
        ]
    )


def as_json(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., report): one JSON document per key with sections of item -> metric -> value.

    A report holds a bounded number of metrics, so collecting one document's entries is bounded.
    """
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), v)))
    items = report.groupBy(*keys, "section", "item").agg(entry("metric", F.col("value")).alias("_metrics"))
    sections = items.groupBy(*keys, "section").agg(entry("item", F.col("_metrics")).alias("_items"))
    whole = sections.groupBy(*keys).agg(entry("section", F.col("_items")).alias("_sections"))
    return whole.select(*keys, F.to_json("_sections", {"ignoreNullFields": "false"}).alias("report"))


def predictions_sections(predictions: DataFrame, actual: str | None = None, predicted: str = "prediction", features: int = 0) -> list[DataFrame]:
    """Number and distribution of predictions, and their fit where actual values are given."""
    figures = predictions.agg(
        F.count(predicted).alias("prediction_count"), F.avg(predicted).alias("mean"), F.stddev_samp(predicted).alias("std"),
        F.min(predicted).alias("min"), F.max(predicted).alias("max"),
    )
    parts = [section(figures, "predictions_summary")]
    return parts if actual is None else [*parts, section(fit_metrics(predictions, actual, predicted, features), "model_performance")]


def did_report(df: DataFrame, target: str, features: Sequence[str] = ()) -> DataFrame:
    """Design, effect and its size, coefficients and cell means of a difference-in-differences model."""
    fit, rows = did_fit(df, target, features)
    effect = did_effect(df.sparkSession, fit)
    cells = crosstab(df).withColumn("cell", F.concat_ws("|", F.concat(F.lit("treated="), F.col("treated")), F.concat(F.lit("post="), F.col("post"))))
    means = cell_means(df, target).withColumn("post", F.concat(F.lit("post="), F.col("post")))
    return stack_sections(
        [
            section(cells.select("cell", "n", "low_cell"), "design", "cell"),
            section(did_balance(df), "design_balance"),
            section(means, "cell_means", "post"),
            section(effect, "effect"),
            section(did_effect_size(effect, rows, target), "effect_size"),
            section(inference(df.sparkSession, fit), "coefficients", "term"),
        ]
    )


def shap_report(attributions: DataFrame, importance: DataFrame, scored: DataFrame, actual: str) -> DataFrame:
    """Importance by attribution and by split, base value and fit of a tree model."""
    base = attributions.agg(F.max("base_value").alias("base_value"), F.count_distinct("feature").alias("features"))
    return stack_sections(
        [
            section(shap_importance(attributions), "shap_importance", "feature"),
            section(importance, "tree_importance", "feature"),
            section(base, "attribution"),
            *predictions_sections(scored, actual),
        ]
    )


def series_report(history_and_forecast: DataFrame, metrics: DataFrame, unit: str, diagnostics: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows and range of the forecast, holdout errors and any per-unit diagnostics of a series model, by unit."""
    ranges = history_and_forecast.groupBy(unit).agg(
        F.count_if(F.col("data_type") == "historical").alias("historical"), F.count_if(F.col("data_type") == "forecast").alias("forecast"),
        F.min(F.when(F.col("data_type") == "forecast", F.col("lower"))).alias("lowest"), F.max(F.when(F.col("data_type") == "forecast", F.col("upper"))).alias("highest"),
    )
    parts = [section(ranges, "forecast", unit), section(metrics, "holdout", unit)]
    return stack_sections([*parts, *[section(d, f"diagnostics_{i + 1}", unit) for i, d in enumerate(diagnostics)]])
