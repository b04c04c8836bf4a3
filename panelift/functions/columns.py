"""Column names and simple column recodes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def standard_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case and underscore all column names; two names may not become one."""
    names = [standard_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after standardizing: {twice}")
    return df.toDF(*names)


def safe_name(text: str) -> str:
    """A value turned into a column-name part: letters, digits and underscores only."""
    return re.sub(r"\W+", "_", text.strip()).strip("_")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def recode_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace values found in the map (a None there makes them missing), keep all others.

    A join whatever the size of the map; Spark broadcasts it only when its size allows.
    """
    if not mapping:
        return df
    table = df.sparkSession.createDataFrame(list(mapping.items()), "_from string, _to string")
    joined = df.join(table, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.when(F.col("_from").isNotNull(), F.col("_to")).otherwise(F.col(column))).select(*df.columns)


def parse_week_id(df: DataFrame, column: str = "week_id", year: str = "year", week: str = "week") -> DataFrame:
    """Split YYYYWW into year and week."""
    text = F.col(column).cast("string")
    return df.withColumns(
        {year: F.substring(text, 1, 4).cast("int"), week: text.substr(F.lit(5), F.length(text)).cast("int")}
    )


def select_numeric(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric columns only; the target must be among them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if target is not None and target not in names:
        raise ValueError(f"target {target!r} is not a numeric column")
    return df.select(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL from here on."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames; columns missing in one are filled with NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def label_encode(df: DataFrame, columns: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Add {column}_code: position of the value in the sorted label list; unknown values become 0.

    The label list may come from another (training) frame. Labels are numbered by an ordered scan
    and joined back, so the list may be large; Spark broadcasts it only when its size allows.
    """
    from panelift.operators.ordered import slice_rows

    source = df if labels is None else labels
    out = df
    for c in columns:
        distinct = source.select(F.col(c).cast("string").alias("_label")).filter("_label is not null").distinct()
        coded = slice_rows(distinct, ["_label"]).numbered("_code").select("_label", F.col("_code").cast("int").alias("_code"))
        out = (
            out.join(coded, F.col(c).cast("string") == F.col("_label"), "left")
            .withColumn(f"{c}_code", F.coalesce("_code", F.lit(0)))
            .drop("_label", "_code")
        )
    return out
