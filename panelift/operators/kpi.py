"""Totals and return figures per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kpi_totals(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Total feature value, total target and their ratio in percent (0 without value)."""
    value = sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in features), F.lit(0.0))
    totals = df.agg(value.alias("total_value"), F.coalesce(F.sum(target), F.lit(0)).cast("double").alias("total_target"))
    roi = F.when(F.col("total_value") > 0, F.col("total_target") / F.col("total_value") * 100).otherwise(0.0)
    return totals.select("total_value", "total_target", roi.alias("roi_percent"))


def kpi_features(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Per feature: total, correlation, target driven, return and efficiency, best return first.

    ``target driven`` is correlation x total target where the correlation is positive.
    """
    structs = []
    for c in features:
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
        corr = F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))
        structs.append(
            F.struct(
                F.lit(c).alias("feature"), F.coalesce(F.sum(x), F.lit(0.0)).alias("total_value"),
                corr.alias("correlation"), F.coalesce(F.sum(y), F.lit(0.0)).alias("_t"),
            )
        )
    packed = df.agg(*[s.alias(f"_s{i}") for i, s in enumerate(structs)])
    rows = packed.select(F.inline(F.array(*[f"_s{i}" for i in range(len(structs))])))
    value, corr, total = F.col("total_value"), F.col("correlation"), F.col("_t")
    driven = F.when(corr > 0, corr * total).otherwise(0.0)
    per_value = lambda top: F.when(value > 0, F.try_divide(top, value)).otherwise(0.0)
    return rows.select(
        "feature", "total_value", "correlation", driven.alias("target_driven"),
        (per_value(driven) * 100).alias("roi_percent"), per_value(total).alias("efficiency"),
    ).orderBy(F.desc("roi_percent"), "feature")


def prediction_summary(df: DataFrame, value: str, model: str = "model") -> DataFrame:
    """Count, mean, sample std, min and max of the predictions per model."""
    return df.groupBy(model).agg(
        F.count(F.lit(1)).alias("total_predictions"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
    )
