"""Registry of the checked queries: each has a Spark plan and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns; without names, all doubles."""
    names = set(columns or [c for c, t in df.dtypes if t == "double"])
    return df.selectExpr(*[f"round(`{c}`, {digits}) as `{c}`" if c in names else f"`{c}`" for c in df.columns])


def rd(expression: str, digits: int, name: str | None = None) -> str:
    """SQL: rounded expression without negative zero."""
    text = f"(round({expression}, {digits}) + 0.0)"
    return f"{text} as {name}" if name else text
