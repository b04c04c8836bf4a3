"""Exact value frequencies, modes and quantiles as distributed group-bys.

A whole column never meets in one aggregation buffer: values are counted by
(group, column, value) first, and order statistics are read off the running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelift.operators.ordered import slice_rows


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), cast: str = "double") -> DataFrame:
    """Long form (by..., variable, value)."""
    picked = df.select(*by, *[F.col(c).cast(cast).alias(c) for c in columns])
    return picked.unpivot(list(by), list(columns), "variable", "value")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), cast: str = "double") -> DataFrame:
    """(by..., variable, value, n) over non-missing values."""
    long = melt(df, columns, by, cast).filter(F.col("value").isNotNull())
    return long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), cast: str = "string") -> DataFrame:
    """Most frequent value per column; the smallest wins ties."""
    counts = value_counts(df, columns, by, cast)
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return counts.groupBy(*by, "variable").agg(best.alias("_b")).select(
        *by, "variable", F.col("_b.v").alias("value"), (-F.col("_b.k")).alias("n")
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (by..., variable, q0, q1, ..., distinct_count)."""
    return quantiles_of_counts(value_counts(df, columns, by), probabilities, by, slices)


def quantiles_of_counts(
    counts: DataFrame,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    slices: int | None = None,
    order: Sequence[str] = ("value",),
) -> DataFrame:
    """Quantiles from (by..., variable, value, n), the values ranked by ``order``.

    Distinct values are range-partitioned in value order and given running counts; the two order
    statistics around each wanted rank are then picked by an aggregation.
    """
    keys = [*by, "variable"]
    sliced = slice_rows(counts, list(order), keys, slices)
    running = sliced.scan(sums={"upto": "n"})
    totals = sliced.frame.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = sliced.attach(running, totals)
    picks, finals = [], []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("total") - 1)
        for tag, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{tag}{i}"))
        share = F.lit(float(p)) * (F.col("_total") - 1)
        part = share - F.floor(share)
        finals.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(f"q{i}"))
    picked = placed.groupBy(*keys).agg(
        F.max("total").alias("_total"), F.count(F.lit(1)).alias("distinct_count"), *picks
    )
    return picked.select(*keys, *finals, "distinct_count")


SKETCH_ACCURACY = 10_000


def quantile_map(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], slices: int | None = None
) -> dict[str, list[float]]:
    """Exact quantiles as numbers on the driver: {column: [value per probability]}, without empty columns.

    An approximate sketch first brackets every wanted rank. Values outside the brackets are only
    counted per gap, so a few thousandths of the rows are shuffled. A rank that should fall
    outside its bracket after all sends its column to the full method.
    """
    names, margin = list(columns), 2.0 / SKETCH_ACCURACY
    edges = [e for p in probabilities for e in (max(0.0, p - margin), min(1.0, p + margin))]
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    sketch = typed.agg(*[F.percentile_approx(c, edges, SKETCH_ACCURACY).alias(f"s{i}") for i, c in enumerate(names)]).first()
    entries = []
    for i, c in enumerate(names):
        found = sketch[f"s{i}"]
        if found is None:
            continue
        segment, value, place = F.lit(0), F.lit(None).cast("double"), 0
        for low, high in _merged(list(zip(found[::2], found[1::2]))):
            inside = (F.col(c) >= F.lit(low)) & (F.col(c) <= F.lit(high))
            segment = F.when(F.col(c) > F.lit(high), place + 2).when(inside, place + 1).otherwise(segment)
            value = F.when(inside, F.col(c)).otherwise(value)
            place += 2
        entries.append(F.struct(F.lit(c).alias("variable"), F.when(F.col(c).isNotNull(), segment).alias("segment"), value.alias("value")))
    if not entries:
        return {}
    long = typed.select(F.inline(F.array(*entries))).filter("segment is not null")
    counts = long.groupBy("variable", "segment", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = {r["variable"]: r for r in quantiles_of_counts(counts, probabilities, slices=slices, order=("segment", "value")).collect()}
    out = {c: [r[f"q{i}"] for i in range(len(probabilities))] for c, r in rows.items()}
    open_columns = [c for c, values in out.items() if any(v is None for v in values)]
    if open_columns:
        full = quantiles(df, open_columns, probabilities, slices=slices).collect()
        out |= {r["variable"]: [r[f"q{i}"] for i in range(len(probabilities))] for r in full}
    return out


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def top_values(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """The ``limit`` most frequent values per column: (variable, value, n, rank).

    The rank filter lets Spark cut each task to ``limit`` rows per column before the shuffle.
    """
    from pyspark.sql import Window

    counts = value_counts(df, columns, cast="string")
    order = Window.partitionBy("variable").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def distinct_sample(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """Up to ``limit`` distinct values per column in value order, with the distinct count's note."""
    from pyspark.sql import Window

    values = value_counts(df, columns, cast="string")
    order = Window.partitionBy("variable").orderBy(F.asc("value"))
    return (
        values.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("variable", "position", "value")
    )


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, missing where the bottom is 0."""
    return F.try_divide(top, bottom)
