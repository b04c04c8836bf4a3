"""Row and column filters and the checks made before a fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.frequency import numeric_columns

MINIMUM_ROWS = 5


def date_range(df: DataFrame, column: str, start: str, end: str, whole_end_day: bool = False) -> DataFrame:
    """Rows from midnight of ``start`` to midnight of ``end`` (both included).

    ``whole_end_day`` keeps the rest of the last day as well.
    """
    kind = dict(df.dtypes)[column]
    if kind == "string":
        value = F.expr(f"try_to_timestamp(`{column}`)")
        kind = "timestamp"
    else:
        value = F.col(column)
    low, high = F.lit(start).cast(kind), F.lit(end).cast(kind)
    if whole_end_day:
        after = F.date_add(F.lit(end).cast("date"), 1).cast(kind)
        return df.filter((value >= low) & (value < after))
    return df.filter(value.between(low, high))


def numeric_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows within [low, high]; text is read as a number, anything else drops out."""
    if dict(df.dtypes)[column] == "string":
        return df.filter(F.col(column).try_cast("double").between(low, high))
    return df.filter(F.col(column).between(low, high))


def keep_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value, as text, is listed; an empty list keeps nothing."""
    text = F.col(column).cast("string")
    return df.filter(text.isin(list(values))) if values else df.filter(F.lit(False))


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Leave out numeric columns whose values are all the same (or all missing but one)."""
    checked = list(columns) if columns is not None else numeric_columns(df)
    bounds = df.agg(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(checked)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(checked)],
    ).first()
    flat = {c for i, c in enumerate(checked) if bounds[f"lo{i}"] is not None and bounds[f"lo{i}"] == bounds[f"hi{i}"]}
    return df.select(*[c for c in df.columns if c not in flat])


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Per flag column: rows with 1, with 0 and with anything else."""
    rows = [
        F.struct(
            F.lit(c).alias("flag"),
            F.count_if(F.col(c).eqNullSafe(F.lit(1))).alias("ones"),
            F.count_if(F.col(c).eqNullSafe(F.lit(0))).alias("zeros"),
            F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias("invalid"),
        )
        for c in flags
    ]
    packed = df.agg(*[r.alias(f"_f{i}") for i, r in enumerate(rows)])
    return packed.select(F.inline(F.array(*[f"_f{i}" for i in range(len(rows))])))


def assert_flags(df: DataFrame, flags: Sequence[str], both: bool = True) -> None:
    """Flags must be 0/1 without gaps; ``both`` also asks for rows of either kind."""
    for r in flag_counts(df, flags).collect():
        if r["invalid"]:
            raise ValueError(f"{r['flag']!r} must contain only 0 and 1 values")
        if both and (not r["ones"] or not r["zeros"]):
            raise ValueError(f"{r['flag']!r} must contain both 0 and 1 rows")


# Extra columns that a model needs besides target and features.
MODEL_COLUMNS = {"did": ("treated", "post"), "synthetic_control": ("treated",), "psm": ("treated",)}
# Fixed values that must equal the reference's: the number of features each model accepts (least, most).
FEATURE_LIMITS = {
    "mlr": (1, 50),
    "distributed_lag": (1, 20),
    "ml_shap": (1, 500),
    "did": (1, 10),
    "var": (1, 6),
    "synthetic_control": (1, 10),
    "causal_impact": (1, 20),
    "psm": (1, 20),
    "forecast": (1, 10),
}


def feature_limits_ok(model: str | None, features: Sequence[str]) -> bool:
    """Whether the number of features is within the model's limits; a model without limits accepts any."""
    least, most = FEATURE_LIMITS.get(model or "", (0, float("inf")))
    return least <= len(list(features)) <= most


def validation_report(
    df: DataFrame, target: str, features: Sequence[str], model: str | None = None, limits: bool = False
) -> DataFrame:
    """One row per check: (check_name, passed). The row count check reads at most five rows.

    With ``limits`` a row ``feature_limits`` tells whether the number of features suits the model
    (``FEATURE_LIMITS``).
    """
    enough = df.select(F.lit(1)).limit(MINIMUM_ROWS).count() >= MINIMUM_ROWS
    present = all(c in df.columns for c in [target, *features])
    extra = all(c in df.columns for c in MODEL_COLUMNS.get(model or "", ()))
    rows = [("minimum_rows", enough), ("required_columns", present), ("model_columns", extra)]
    if limits:
        rows.append(("feature_limits", feature_limits_ok(model, features)))
    return df.sparkSession.createDataFrame(rows, "check_name string, passed boolean")


def is_trainable(df: DataFrame, target: str, features: Sequence[str], model: str | None = None, limits: bool = False) -> bool:
    return all(r["passed"] for r in validation_report(df, target, features, model, limits).collect())
