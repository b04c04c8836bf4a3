"""Missing-data methods. Every method returns the frame with the given columns repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.frequency import modes, numeric_columns, quantile_map
from panelift.operators.ordered import slice_rows
from panelift.session import spill

WHOLE = ("tinyint", "smallint", "int", "bigint")
METHODS = ("listwise", "zero", "mean", "median", "ffill", "bfill", "interpolate", "mode")


def _split(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric = set(numeric_columns(df))
    return [c for c in columns if c in numeric], [c for c in columns if c not in numeric]


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0 for numbers and '0' for text."""
    return df.na.fill(0, subset=list(columns)).na.fill("0", subset=list(columns))


def _fill_with(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill gaps; a fill of the column's own kind keeps its type, a mean or median turns it into double."""
    types = dict(df.dtypes)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if isinstance(v, float) else F.coalesce(F.col(c), F.lit(v).cast(types[c]))
        for c, v in values.items()
        if v is not None
    }
    return df.withColumns(filled) if filled else df


def _text_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each text, date or flag column, one row per column.

    An empty text column gets '0'; an empty date or flag column stays empty.
    """
    if not columns:
        return {}
    types = dict(df.dtypes)
    found = {r["variable"]: r["value"] for r in modes(df, columns).collect()}
    return {c: found.get(c, "0" if types[c] == "string" else None) for c in columns}


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numeric, text = _split(df, columns)
    values = _text_modes(df, text)
    if numeric:
        values |= df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    return _fill_with(df, values)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numeric, text = _split(df, columns)
    values = _text_modes(df, text)
    if numeric:
        values |= {c: q[0] for c, q in quantile_map(df, numeric, [0.5]).items()}
    return _fill_with(df, values)


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on ties, 0 when there is none. Whole numbers are compared exactly."""
    numeric, text = _split(df, columns)
    values = _text_modes(df, text)
    types = dict(df.dtypes)
    whole = [c for c in numeric if types[c] in WHOLE]
    for some, cast, empty in ((whole, "bigint", 0), ([c for c in numeric if c not in whole], "double", 0.0)):
        if some:
            found = {r["variable"]: r["value"] for r in modes(df, some, cast=cast).collect()}
            values |= {c: found.get(c, empty) for c in some}
    return _fill_with(df, values)


def fill_forward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Carry the last seen value on; gaps at the start become 0 (dates and flags stay missing there)."""
    sliced = slice_rows(df, order_by, partition_by)
    carried = sliced.scan(last={c: c for c in columns})
    return fill_zero(carried.select(*df.columns), columns)


def fill_backward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Carry the next seen value back; gaps at the end become 0 (dates and flags stay missing there)."""
    sliced = slice_rows(df, order_by, partition_by)
    carried = sliced.scan(following={c: c for c in columns})
    return fill_zero(carried.select(*df.columns), columns)


def interpolate(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Linear by row position between seen values.

    Gaps at the end take the last value; gaps at the start take the column mean computed after
    interpolation; text columns take their most frequent value.
    """
    numeric, text = _split(df, columns)
    out = _fill_with(df, _text_modes(df, text))
    if not numeric:
        return out
    sliced = slice_rows(out, order_by, partition_by)
    placed = sliced.numbered("_row").withColumns(
        {f"_at_{c}": F.when(F.col(c).isNotNull(), F.col("_row")) for c in numeric}
    )
    seen = sliced.scan(
        last={f"_pv_{c}": c for c in numeric} | {f"_pr_{c}": f"_at_{c}" for c in numeric},
        following={f"_nv_{c}": c for c in numeric} | {f"_nr_{c}": f"_at_{c}" for c in numeric},
        frame=placed,
    )
    blended = {}
    for c in numeric:
        before, after = F.col(f"_pv_{c}"), F.col(f"_nv_{c}")
        share = F.try_divide(F.col("_row") - F.col(f"_pr_{c}"), F.col(f"_nr_{c}") - F.col(f"_pr_{c}"))
        inner = before + (after - before) * share
        blended[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(
            F.when(before.isNotNull() & after.isNotNull(), inner).otherwise(before.cast("double"))
        )
    done = spill(seen.withColumns(blended).select(*df.columns), "interpolated")
    return fill_mean(done, numeric)


def handle_missing(
    df: DataFrame,
    method: str,
    columns: Sequence[str],
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Dispatch by method name (see METHODS)."""
    plain = {"listwise": drop_missing, "zero": fill_zero, "mean": fill_mean, "median": fill_median, "mode": fill_mode}
    ordered = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": interpolate}
    if method in plain:
        return plain[method](df, columns)
    if method in ordered:
        return ordered[method](df, columns, order_by, partition_by)
    raise ValueError(f"unknown method {method!r}; use one of {METHODS}")


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, missing_count, missing_percent, total_missing, completeness)."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    rows = counts.select("_n", total.alias("total_missing"), *columns)
    long = rows.unpivot(["_n", "total_missing"], list(columns), "variable", "missing_count")
    share = F.try_divide(F.col("missing_count"), F.col("_n")) * 100
    completeness = 100 - F.try_divide(F.col("total_missing"), F.col("_n") * len(columns)) * 100
    return long.select(
        "variable", "missing_count", share.alias("missing_percent"), "total_missing", completeness.alias("completeness")
    )
