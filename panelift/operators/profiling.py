"""Column and data-set profiles as tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from panelift.operators.frequency import quantile_map, value_counts

OUTLIER_QUANTILE = 0.99
# Words that make a column a candidate for a date (fixed values).
DATE_WORDS = ("date", "time", "timestamp", "created", "updated", "day", "month", "year")
PARSE_SHARE = 0.7


def _tidy(df: DataFrame, per_column: dict[str, list[Column]]) -> DataFrame:
    """Aggregate in one scan and turn the result into one row per column."""
    packed = df.agg(*[F.struct(F.lit(c).alias("variable"), *exprs).alias(f"_p{i}") for i, (c, exprs) in enumerate(per_column.items())])
    return packed.select(F.inline(F.array(*[f"_p{i}" for i in range(len(per_column))])))


def describe_basic(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation, min and max per column."""
    return _tidy(
        df,
        {
            c: [
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ]
            for c in columns
        },
    )


def describe_full(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column (exact quartiles)."""
    basics = _tidy(
        df,
        {
            c: [
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ]
            for c in columns
        },
    )
    middle = [(c, *q) for c, q in quantile_map(df, columns, [0.25, 0.5, 0.75]).items()]
    named = df.sparkSession.createDataFrame(middle, "variable string, q25 double, q50 double, q75 double")
    return basics.join(named, "variable", "left").select("variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def outliers_above_quantile(df: DataFrame, columns: Sequence[str], quantile: float = OUTLIER_QUANTILE) -> DataFrame:
    """Rows above the quantile: (variable, threshold, outlier_count, outlier_percent)."""
    cut = {c: q[0] for c, q in quantile_map(df, columns, [quantile]).items()}
    return _tidy(
        df,
        {
            c: [
                F.lit(cut.get(c)).cast("double").alias("threshold"),
                F.count_if(F.col(c) > F.lit(cut.get(c)).cast("double")).alias("outlier_count"),
                (F.try_divide(F.count_if(F.col(c) > F.lit(cut.get(c)).cast("double")), F.count(F.lit(1))) * 100).alias("outlier_percent"),
            ]
            for c in columns
        },
    )


def _iqr_columns(c: str, low: float | None, high: float | None) -> list[Column]:
    lo, hi = F.lit(low).cast("double"), F.lit(high).cast("double")
    outside = F.count_if((F.col(c) < lo) | (F.col(c) > hi))
    return [outside.alias("outlier_count"), (F.try_divide(outside, F.count(F.lit(1))) * 100).alias("outlier_percent")]


def _iqr_bounds(q1: float, q3: float) -> tuple[float, float]:
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def outliers_iqr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside q1 - 1.5 iqr .. q3 + 1.5 iqr."""
    bounds = {c: _iqr_bounds(*q) for c, q in quantile_map(df, columns, [0.25, 0.75]).items()}
    return _tidy(
        df,
        {
            c: [
                F.lit(bounds.get(c, (None, None))[0]).cast("double").alias("lower_bound"),
                F.lit(bounds.get(c, (None, None))[1]).cast("double").alias("upper_bound"),
                *_iqr_columns(c, *bounds.get(c, (None, None))),
            ]
            for c in columns
        },
    )


def unique_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of distinct present values per column, by one grouping of (column, value) as stored.

    Values are compared as text, so whole numbers beyond 2^53 stay apart; 0.0 takes away the sign of zero.
    """
    kinds = dict(df.dtypes)
    exact = df.select(*[(F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c)).cast("string").alias(c) for c in columns])
    counted = value_counts(exact, columns, cast="string").groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return {r["variable"]: r["n"] for r in counted.collect()}


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full numeric profile, one row per column. Skewness and kurtosis are population (excess)."""
    order = quantile_map(df, columns, [0.25, 0.5, 0.75])
    unique = unique_counts(df, columns)
    per_column = {}
    for c in columns:
        r = order.get(c)
        q25, median, q75 = r if r else (None, None, None)
        low, high = _iqr_bounds(q25, q75) if r else (None, None)
        value = F.col(c).cast("double")
        number = lambda v, name: F.lit(v).cast("double").alias(name)
        flat = F.min(c).eqNullSafe(F.max(c))
        per_column[c] = [
            F.count(F.lit(1)).alias("count"),
            F.count(c).alias("non_null_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            (F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100).alias("null_percent"),
            F.avg(value).alias("mean"),
            number(median, "median"),
            F.stddev_samp(value).alias("std"),
            F.var_samp(value).alias("variance"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            (F.max(value) - F.min(value)).alias("range"),
            number(q25, "q25"),
            number(q75, "q75"),
            number(None if r is None else q75 - q25, "iqr"),
            F.when(~flat, F.skewness(value)).alias("skewness"),
            F.when(~flat, F.kurtosis(value)).alias("kurtosis"),
            F.lit(unique.get(c, 0)).cast("long").alias("unique_count"),
            F.count_if(value == 0).alias("zero_count"),
            F.count_if(value < 0).alias("negative_count"),
            F.count_if(value > 0).alias("positive_count"),
            *_iqr_columns(c, low, high),
        ]
    return _tidy(df, per_column)


def profile_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, distinct values, mode and text-length figures per column."""
    basics = _tidy(
        df,
        {
            c: [
                F.count(F.lit(1)).alias("count"),
                F.count(c).alias("non_null_count"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
                (F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) * 100).alias("null_percent"),
                F.avg(F.length(F.col(c).cast("string"))).alias("avg_length"),
                F.min(F.length(F.col(c).cast("string"))).cast("long").alias("min_length"),
                F.max(F.length(F.col(c).cast("string"))).cast("long").alias("max_length"),
                F.count_if(F.col(c).cast("string") == "").alias("empty_count"),
            ]
            for c in columns
        },
    )
    counts = value_counts(df, columns, cast="string")
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    values = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("unique_count"), best.alias("_b"))
    # One row per column on either side.
    return basics.join(values, "variable", "left").select(
        *basics.columns, F.coalesce("unique_count", F.lit(0)).alias("unique_count"), F.col("_b.v").alias("mode"), (-F.col("_b.k")).alias("mode_count")
    )


def profile_datetime(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min, max, whole days between them and distinct values."""
    kinds = dict(df.dtypes)
    days = lambda c: F.floor((_seconds(F.max(c), kinds[c]) - _seconds(F.min(c), kinds[c])) / 86400).cast("long")
    basics = _tidy(
        df,
        {
            c: [
                F.count(F.lit(1)).alias("count"),
                F.count(c).alias("non_null_count"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
                F.min(c).alias("min_date"),
                F.max(c).alias("max_date"),
                days(c).alias("range_days"),
            ]
            for c in columns
        },
    )
    unique = value_counts(df, columns, cast="string").groupBy("variable").agg(F.count(F.lit(1)).alias("unique_dates"))
    return basics.join(unique, "variable", "left").withColumn("unique_dates", F.coalesce("unique_dates", F.lit(0)))


def _seconds(value: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(value) * 86400
    if kind == "timestamp":
        return F.unix_micros(value) / 1e6
    return F.unix_micros(value.cast("timestamp")) / 1e6


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    """First and last date and number of distinct periods."""
    periods = df.groupBy(column).agg(F.lit(1).alias("_one"))
    return periods.agg(F.min(column).alias("start_date"), F.max(column).alias("end_date"), F.count(column).alias("total_periods"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and their percentage."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    total, extra = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return groups.agg(
        total.alias("row_count"),
        extra.alias("duplicate_rows"),
        (F.coalesce(F.try_divide(extra, total), F.lit(0.0)) * 100).alias("duplicate_percent"),
    )


def column_kind(data_type) -> str:
    if isinstance(data_type, NumericType):
        return "numeric"
    if isinstance(data_type, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    return "categorical"


def profile_dataset(df: DataFrame) -> DataFrame:
    """One-row data-quality summary."""
    kinds = [column_kind(f.dataType) for f in df.schema.fields]
    width = len(df.columns)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls)
    missing = sum((F.col(f"_n{i}") for i in range(width)), F.lit(0))
    with_gaps = sum(((F.col(f"_n{i}") > 0).cast("long") for i in range(width)), F.lit(0))
    cells = F.col("row_count") * width
    quality = counted.select(
        "row_count",
        F.lit(width).cast("long").alias("column_count"),
        cells.alias("total_cells"),
        missing.alias("total_missing"),
        (F.try_divide(cells - missing, cells) * 100).alias("completeness"),
        with_gaps.alias("columns_with_missing"),
        *[F.lit(kinds.count(k)).cast("long").alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")],
    )
    repeats = duplicate_rows(df).drop("row_count")
    # Two one-row results side by side.
    return quality.withColumn("_k", F.lit(1)).join(repeats.withColumn("_k", F.lit(1)), "_k").drop("_k")


def detect_types(df: DataFrame) -> DataFrame:
    """Semantic type per column: datetime, integer, numeric or categorical.

    A column named like a date is datetime when over 70 % of its values parse and they span several
    years or lie after 1990. Otherwise over 70 % numeric values make it integer (all whole) or
    numeric. Columns stored as dates are datetime whatever their name.
    """
    per_column = {}
    for f in df.schema.fields:
        value = F.col(f.name)
        seen = F.count(value)
        dated = any(w in f.name.lower() for w in DATE_WORDS)
        kind = column_kind(f.dataType)
        date_rule = F.lit(False)
        if kind == "datetime":
            date_rule = seen > 0
        elif dated and isinstance(f.dataType, StringType):
            stamp = F.expr(f"try_to_timestamp(`{f.name}`)")
            several = F.min(F.year(stamp)) < F.max(F.year(stamp))
            date_rule = (F.count(stamp) > seen * PARSE_SHARE) & (several | (F.min(F.year(stamp)) > 1990))
        if kind == "numeric":
            number = value.cast("double")
        elif isinstance(f.dataType, (StringType, BooleanType)):
            number = value.try_cast("double") if isinstance(f.dataType, StringType) else value.cast("int").cast("double")
        else:
            number = F.lit(None).cast("double")
        enough = F.count(number) > seen * PARSE_SHARE
        whole = F.count_if(number % 1 != 0) == 0
        label = (
            F.when(F.coalesce(date_rule, F.lit(False)), "datetime")
            .when(enough & whole, "integer")
            .when(enough, "numeric")
            .otherwise("categorical")
        )
        per_column[f.name] = [label.alias("detected_type")]
    return _tidy(df, per_column)

