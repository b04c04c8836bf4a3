"""Pearson correlation as a tidy (var_i, var_j, corr) table and figures derived from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.functions.columns import nan_to_null
from panelift.operators.gram import pair_sums

TIDY = "i int, j int, var_i string, var_j string, corr double, pairs long"
#: Pairwise SQL aggregates need k(k+1) + k^2 buffers; from three columns on the masked matrices are cheaper.
CORRELATION_SQL_WIDTH = 2


def correlation_values(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(correlations, pair counts), each pair over the rows where both values are present (NaN is missing).

    Up to ``CORRELATION_SQL_WIDTH`` columns one aggregate of pair correlations; wider tables add up masked matrices.
    """
    names = list(columns)
    k = len(names)
    df = nan_to_null(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]))
    if k <= CORRELATION_SQL_WIDTH:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        present = lambda i, j: F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), F.col(f"v{i}"))
        found = df.agg(
            *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
            *[F.var_pop(present(i, j)).alias(f"s{i}_{j}") for i in range(k) for j in range(k)],
            *[F.count(present(i, j)).alias(f"n{i}_{j}") for i, j in pairs],
        ).first()
        corr, n = np.full((k, k), np.nan), np.zeros((k, k), int)
        for i, j in pairs:
            n[i, j] = n[j, i] = found[f"n{i}_{j}"]
            spread = (found[f"s{i}_{j}"] or 0.0) * (found[f"s{j}_{i}"] or 0.0)
            if spread > 0:  # a constant column has no correlation
                corr[i, j] = corr[j, i] = found[f"c{i}_{j}"] / spread**0.5
        return np.clip(corr, -1.0, 1.0), n
    names = [f"v{i}" for i in range(k)]
    level = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    s = pair_sums(df, names, [level[f"m{i}"] or 0.0 for i in range(k)])
    with np.errstate(divide="ignore", invalid="ignore"):
        covariance = s["xy"] - s["x"] * s["x"].T / s["n"]
        spread = s["xx"] - s["x"] ** 2 / s["n"]
        # Rounding leaves a trace of spread in a constant column; it has no correlation.
        spread = np.where(spread > 1e-12 * s["xx"], spread, np.nan)
        corr = covariance / np.sqrt(spread * spread.T)
    return np.clip(corr, -1.0, 1.0), s["n"].astype(int)


def tidy(spark, names: Sequence[str], corr: np.ndarray, n: np.ndarray) -> DataFrame:
    """k x k rows; a constant column has no correlation (NULL)."""
    rows = [
        (i, j, a, b, None if np.isnan(corr[i, j]) else float(corr[i, j]), int(n[i, j]))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return spark.createDataFrame(rows, TIDY)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return tidy(df.sparkSession, list(columns), *correlation_values(df, columns))


def correlation_summary(matrix: DataFrame) -> DataFrame:
    """Mean, max and min of the absolute values over the whole matrix, diagonal included."""
    size = F.abs("corr")
    return matrix.agg(
        F.avg(size).alias("mean_abs_corr"), F.max(size).alias("max_abs_corr"), F.min(size).alias("min_abs_corr")
    )


def correlation_histogram(matrix: DataFrame, bins: int = 50) -> DataFrame:
    """Upper-triangle correlations in equal bins over -1..1: (bin, low, high, n)."""
    width = 2.0 / bins
    upper = matrix.filter((F.col("i") < F.col("j")) & F.col("corr").isNotNull())
    bin_index = F.least(F.floor((F.col("corr") + 1) / width), F.lit(bins - 1)).cast("int")
    counted = upper.groupBy(bin_index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    low = F.col("bin") * F.lit(width) - 1
    return counted.select("bin", low.alias("low"), (low + width).alias("high"), "n")


def correlation_with_target(matrix: DataFrame, target: str) -> DataFrame:
    """(variable, corr) of every other column with the target."""
    return matrix.filter((F.col("var_j") == target) & (F.col("var_i") != target)).select(
        F.col("var_i").alias("variable"), "corr"
    )


