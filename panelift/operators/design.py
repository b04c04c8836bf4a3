"""Experiment design: treated and post flags, two-by-two tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelift.operators.frequency import quantile_map

logger = logging.getLogger(__name__)
LOW_CELL = 5
FEW_CONTROLS = 10


def _flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def treated_by_location(df: DataFrame, column: str, locations: Sequence[str]) -> DataFrame:
    return df.withColumn("treated", _flag(F.col(column).isin(list(locations))))


def post_by_date(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """1 strictly after the cutoff; text dates are parsed."""
    kind = dict(df.dtypes)[column]
    out = df.withColumn(column, F.to_timestamp(column)) if kind == "string" else df
    kind = "timestamp" if kind == "string" else kind
    return out.withColumn("post", _flag(F.col(column) > F.lit(cutoff).cast(kind)))


def post_by_period(df: DataFrame, column: str, cutoff: int | float | str) -> DataFrame:
    return df.withColumn("post", _flag(F.col(column) > F.lit(cutoff)))


def treated_by_quantile(df: DataFrame, column: str, quantile: float = 0.5, above: bool = True) -> DataFrame:
    """Threshold at the exact quantile; a missing metric is never treated."""
    found = quantile_map(df, [column], [quantile])
    if column not in found:
        return df.withColumn("treated", F.lit(0))
    threshold = F.lit(found[column][0])
    condition = F.col(column) > threshold if above else F.col(column) <= threshold
    return df.withColumn("treated", _flag(condition))


def crosstab(df: DataFrame, rows: str = "treated", columns: str = "post") -> DataFrame:
    """Counts per cell of the grid of all values seen, with margins ('All'); empty and low cells are marked."""
    seen = df.groupBy(rows, columns).agg(F.count(F.lit(1)).cast("long").alias("_n"))
    # two flags have few values, so the grid is built from two short arrays
    values = seen.agg(*[F.array_distinct(F.collect_list(F.struct(F.col(c)))).alias(f"_{c}") for c in (rows, columns)])
    grid = values.select(F.explode(f"_{rows}").alias("_r"), f"_{columns}").select(
        F.col("_r")[rows].alias(rows), F.explode(f"_{columns}").alias("_c")
    ).select(rows, F.col("_c")[columns].alias(columns), F.lit(0).cast("long").alias("_n"))
    cells = seen.unionByName(grid).groupBy(rows, columns).agg(F.sum("_n").alias("_n"))
    cube = cells.cube(rows, columns).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_g"))
    label = lambda name, bit: F.when(F.col("_g").bitwiseAND(bit) != 0, F.lit("All")).otherwise(F.col(name).cast("string"))
    return cube.select(
        label(rows, 2).alias(rows), label(columns, 1).alias(columns), "n", (F.col("n") < LOW_CELL).alias("low_cell")
    )


def prepare_did(df: DataFrame, location: str, locations: Sequence[str], date: str, cutoff: str) -> DataFrame:
    """Treated and post flags; thin cells of the two-by-two design are logged."""
    out = post_by_date(treated_by_location(df, location, locations), date, cutoff)
    counts = {(r["treated"], r["post"]): r["n"] for r in out.groupBy("treated", "post").agg(F.count(F.lit(1)).alias("n")).collect()}
    for cell in ((0, 0), (0, 1), (1, 0), (1, 1)):
        if counts.get(cell, 0) < LOW_CELL:
            logger.warning("few rows in treated=%s, post=%s: %s", *cell, counts.get(cell, 0))
    return out


def prepare_synthetic_control(df: DataFrame, location: str, treated_location: str) -> tuple[DataFrame, DataFrame]:
    """(flagged rows, one-row summary). Fails without treated rows."""
    out = treated_by_location(df, location, [treated_location])
    per_unit = out.groupBy(location, "treated").agg(F.count(F.lit(1)).alias("_n"))
    summary = per_unit.agg(
        F.coalesce(F.sum(F.when(F.col("treated") == 1, F.col("_n"))), F.lit(0)).alias("treated_rows"),
        F.coalesce(F.sum(F.when(F.col("treated") == 0, F.col("_n"))), F.lit(0)).alias("control_rows"),
        F.count_if(F.col("treated") == 0).alias("control_units"),
    )
    counts = summary.first()
    if counts["treated_rows"] == 0:
        raise ValueError(f"no rows for treated location {treated_location!r}")
    if counts["control_rows"] < FEW_CONTROLS:
        logger.warning("few control rows: %s", counts["control_rows"])
    return out, df.sparkSession.createDataFrame([counts], summary.schema)


def did_balance(df: DataFrame) -> DataFrame:
    """Smallest to largest cell of the two-by-two table; balanced above 0.2."""
    cells = df.groupBy("treated", "post").agg(F.count(F.lit(1)).alias("_n"))
    spread = cells.agg(
        F.min("_n").alias("_lo"), F.max("_n").alias("max_cell"), F.count(F.lit(1)).alias("_cells")
    )
    smallest = F.when(F.col("_cells") < 4, F.lit(0)).otherwise(F.col("_lo")).cast("long")
    ratio = F.coalesce(F.try_divide(smallest, F.col("max_cell")), F.lit(0.0))
    return spread.select(
        smallest.alias("min_cell"), "max_cell", ratio.alias("balance_ratio"), (ratio > 0.2).alias("balanced")
    )


def cell_means(df: DataFrame, target: str) -> DataFrame:
    """Mean target by post (rows) and treated (columns)."""
    return df.groupBy("post").agg(
        F.avg(F.when(F.col("treated") == 0, F.col(target))).alias("control_mean"),
        F.avg(F.when(F.col("treated") == 1, F.col(target))).alias("treated_mean"),
    )
