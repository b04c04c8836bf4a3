"""Variance inflation, high-correlation pairs, variable reduction and their bands.

Everything after the two moment passes works on tables with one row per variable or pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelift.operators.gram import Moments, moments

CORRELATION_THRESHOLD = 0.8
VIF_THRESHOLD = 10.0
CONCERN_THRESHOLD = 5.0
PERFECT = 1e-12


def vif_values(m: Moments) -> dict[str, float]:
    """1 / (1 - R2) of each column on all others; infinite when it is a linear combination of them."""
    spread = np.sqrt(np.clip(np.diag(m.cross), 0.0, None))
    kept = [i for i in range(len(m.names)) if spread[i] > 0]
    if not kept:
        return {}
    r = m.cross[np.ix_(kept, kept)] / np.outer(spread[kept], spread[kept])
    np.fill_diagonal(r, 1.0)
    out = {}
    regular = np.linalg.eigvalsh(r)[0] > PERFECT
    inverse = np.linalg.inv(r) if regular else None
    for a, i in enumerate(kept):
        if regular:
            out[m.names[i]] = max(1.0, float(inverse[a, a]))
            continue
        rest = [b for b in range(len(kept)) if b != a]
        explained = float(r[a, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ r[rest, a]) if rest else 0.0
        out[m.names[i]] = float("inf") if 1.0 - explained < PERFECT * 100 else 1.0 / (1.0 - explained)
    return out


def vif(df: DataFrame, columns: Sequence[str], threshold: float = VIF_THRESHOLD) -> DataFrame:
    """(variable, vif, high); constant columns are left out first, then rows with gaps dropped.

    A constant or empty column therefore costs no rows.
    """
    ends = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    moving = [c for i, c in enumerate(columns) if ends[f"lo{i}"] is not None and ends[f"lo{i}"] != ends[f"hi{i}"]]
    values = vif_values(moments(df, moving)) if moving else {}
    rows = [(c, v, v > threshold) for c, v in values.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double, high boolean")


def top_vif(table: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` variables of largest factor, name order on ties."""
    return table.orderBy(F.desc("vif"), "variable").limit(limit)


def top_pairs(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` pairs of largest absolute correlation, name order on ties."""
    return pairs.orderBy(F.desc("abs_correlation"), "variable_1", "variable_2").limit(limit)


def vif_level(value: Column) -> Column:
    """severe above 10, moderate above 5, acceptable otherwise."""
    return F.when(value > 10, "severe").when(value > 5, "moderate").otherwise("acceptable")


def vif_category(value: Column) -> Column:
    """severe above 50, high above 10, moderate above 5, acceptable otherwise."""
    return F.when(value > 50, "severe").when(value > 10, "high").when(value > 5, "moderate").otherwise("acceptable")


def vif_advice(value: Column) -> Column:
    infinite = value == float("inf")
    return (
        F.when(infinite, "remove_immediately").when(value > 10, "consider_removal").when(value > 5, "monitor").otherwise("keep")
    )


def vif_bands(table: DataFrame) -> DataFrame:
    """Band, category, concern flag and advice per variable."""
    v = F.col("vif")
    return table.select(
        "variable", "vif", vif_level(v).alias("level"), vif_category(v).alias("category"),
        (v > CONCERN_THRESHOLD).alias("concern"), vif_advice(v).alias("advice"),
    )


def high_pairs(
    matrix: DataFrame, target: str, threshold: float = CORRELATION_THRESHOLD, include_target: bool = False
) -> DataFrame:
    """Upper-triangle pairs above the threshold; the one closer to the target is kept.

    On a tie the second stays. The target itself takes part only with ``include_target``.
    """
    to_target = matrix.filter(F.col("var_j") == target).select(F.col("var_i").alias("_v"), F.abs("corr").alias("_t"))
    pairs = matrix.filter((F.col("i") < F.col("j")) & (F.abs("corr") > threshold))
    if not include_target:
        pairs = pairs.filter((F.col("var_i") != target) & (F.col("var_j") != target))
    joined = (
        pairs.join(to_target.withColumnsRenamed({"_v": "var_i", "_t": "target_corr_i"}), "var_i", "left")
        .join(to_target.withColumnsRenamed({"_v": "var_j", "_t": "target_corr_j"}), "var_j", "left")
    )
    first = F.coalesce(F.col("target_corr_i") > F.col("target_corr_j"), F.lit(False))
    return joined.select(
        F.col("var_i").alias("variable_1"),
        F.col("var_j").alias("variable_2"),
        F.col("corr").alias("correlation"),
        F.abs("corr").alias("abs_correlation"),
        "target_corr_i",
        "target_corr_j",
        F.when(first, F.col("var_i")).otherwise(F.col("var_j")).alias("keep"),
        F.when(first, F.col("var_j")).otherwise(F.col("var_i")).alias("remove"),
    )


def correlation_bands(pairs: DataFrame) -> DataFrame:
    """Number of pairs at 0.99 and above, 0.95 to 0.99, 0.8 to 0.95."""
    a = F.col("abs_correlation")
    return pairs.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(a >= 0.99).alias("perfect"),
        F.count_if((a >= 0.95) & (a < 0.99)).alias("very_high"),
        F.count_if((a >= 0.8) & (a < 0.95)).alias("high"),
    )


def removal_breakdown(pairs: DataFrame, vifs: DataFrame, target: str) -> DataFrame:
    """Variables to remove with the reasons: (variable, by_correlation, by_vif, both)."""
    by_pair = pairs.select(F.col("remove").alias("variable"), F.lit(1).alias("c"), F.lit(0).alias("v"))
    by_vif = vifs.filter("high").select("variable", F.lit(0).alias("c"), F.lit(1).alias("v"))
    flags = by_pair.unionByName(by_vif).filter(F.col("variable") != target)
    grouped = flags.groupBy("variable").agg(F.max("c").alias("c"), F.max("v").alias("v"))
    c, v = F.col("c") == 1, F.col("v") == 1
    return grouped.select("variable", c.alias("by_correlation"), v.alias("by_vif"), (c & v).alias("both"))


def feature_reduction(columns: Sequence[str], target: str, removals: DataFrame) -> DataFrame:
    """Every numeric variable with the decision: (variable, decision, reduction_percent)."""
    names = removals.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    kept = names.join(removals.select("variable"), "variable", "left_anti").withColumn("decision", F.lit("keep"))
    gone = removals.select("variable", F.lit("remove").alias("decision"))
    both = kept.unionByName(gone)
    share = both.agg((F.count_if(F.col("decision") == "remove") * 100 / F.lit(len(list(columns)))).alias("reduction_percent"))
    return both.withColumn("_k", F.lit(1)).join(F.broadcast(share.withColumn("_k", F.lit(1))), "_k").drop("_k")


def reduced_dataset(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Only the kept variables, in the frame's column order."""
    kept = {r["variable"] for r in decisions.filter("decision = 'keep'").collect()}
    return df.select(*[c for c in df.columns if c in kept])


def variable_ranking(to_target: DataFrame, vifs: DataFrame, removals: DataFrame) -> DataFrame:
    """Keep-score |corr with target| * 100 - min(vif, 100) / 10, best first."""
    flagged = removals.select("variable", F.lit(True).alias("_gone"))
    joined = to_target.join(vifs.select("variable", "vif"), "variable", "left").join(flagged, "variable", "left")
    strength = F.abs("corr")
    capped = F.coalesce(F.least("vif", F.lit(100.0)), F.lit(0.0))
    scored = joined.select(
        "variable", strength.alias("target_corr"), capped.alias("vif"),
        (strength * 100 - capped / 10).alias("score"),
        F.when(F.col("_gone"), "remove").otherwise("keep").alias("action"),
    )
    # One row per variable, so one window partition is small.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "variable")))


def severity(pairs: DataFrame, vifs: DataFrame, removals: DataFrame, variable_count: int) -> DataFrame:
    """Counts and two severity labels: by share of removals and by absolute counts."""
    rows = (
        pairs.select(F.lit(1).alias("p"), F.lit(0).alias("v"), F.lit(0).alias("r"))
        .unionByName(vifs.select(F.lit(0).alias("p"), F.col("high").cast("int").alias("v"), F.lit(0).alias("r")))
        .unionByName(removals.select(F.lit(0).alias("p"), F.lit(0).alias("v"), F.lit(1).alias("r")))
    )
    counted = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("p", "high_pairs"), ("v", "high_vif"), ("r", "removals"))])
    p, v, r = F.col("high_pairs"), F.col("high_vif"), F.col("removals")
    share = r * 100 / F.lit(variable_count)
    by_share = (
        F.when((share > 80) | (p > 100), "critical").when((share > 50) | (p > 50), "high")
        .when((share > 20) | (p > 20), "medium").otherwise("low")
    )
    by_count = (
        F.when((r > 10) | (p > 50) | (v > 10), "critical").when((r > 5) | (p > 20) | (v > 5), "high")
        .when((r > 2) | (p > 10) | (v > 2), "medium").otherwise("low")
    )
    return counted.select("high_pairs", "high_vif", "removals", by_share.alias("severity_by_share"), by_count.alias("severity_by_count"))
