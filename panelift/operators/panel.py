"""Panel preparation: monthly activity to weekly unit-level panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.functions.calendar import week_calendar
from panelift.functions.columns import safe_name
from panelift.session import spill


def split_brand(df: DataFrame, client: str, brand: str = "brand") -> tuple[DataFrame, DataFrame]:
    """(client rows, competitor rows); a missing brand is a competitor."""
    mine = F.col(brand).eqNullSafe(F.lit(client))
    return df.filter(mine), df.filter(~mine)


def monthly_totals(
    df: DataFrame,
    sums: Mapping[str, str],
    counts: Mapping[str, str] | None = None,
    keys: Sequence[str] = ("city", "month"),
) -> DataFrame:
    """Sum and non-null count per key, given as {output: input}; rows with a missing key are left out."""
    present = df.na.drop(subset=list(keys))
    aggregates = [F.coalesce(F.sum(c), F.lit(0)).alias(o) for o, c in sums.items()]
    aggregates += [F.count(c).alias(o) for o, c in (counts or {}).items()]
    return present.groupBy(*keys).agg(*aggregates)


def distinct_brands(df: DataFrame, client: str, brand: str = "brand") -> list[str]:
    """All competitor brands in name order, for the wide form (a few columns per brand).

    With more brands than a table should have columns, use ``brand_long``.
    """
    _, others = split_brand(df, client, brand)
    return sorted(r[0] for r in others.select(brand).na.drop().distinct().collect())


def brand_long(
    df: DataFrame, sums: Mapping[str, str], keys: Sequence[str] = ("city", "month"), brand: str = "brand"
) -> DataFrame:
    """One row per key and brand, whatever the number of brands; rows with a missing key or brand are left out."""
    present = df.na.drop(subset=[*keys, brand])
    return present.groupBy(*keys, brand).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(o) for o, c in sums.items()])


def brand_pivot(
    df: DataFrame,
    brands: Sequence[str],
    sums: Mapping[str, str],
    keys: Sequence[str] = ("city", "month"),
    brand: str = "brand",
) -> DataFrame:
    """One set of {brand}_{metric} columns per brand; combinations that never occur are 0."""
    present = df.na.drop(subset=list(keys)).filter(F.col(brand).isin(list(brands)))
    wide = present.groupBy(*keys).pivot(brand, list(brands)).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    one = len(sums) == 1
    names = [f"{safe_name(b)}_{m}" for b in brands for m in sums]
    if len(set(names)) < len(names):
        raise ValueError("two brands share a column name; recode them first")
    expected = [b if one else f"{b}_{m}" for b in brands for m in sums]
    if wide.columns != [*keys, *expected]:
        raise ValueError(f"unexpected pivot columns {wide.columns}")
    return wide.toDF(*keys, *names).na.fill(0)


def monthly_wide(
    ads: DataFrame,
    client: str,
    sums: Mapping[str, str],
    counts: Mapping[str, str],
    brands: Sequence[str] = (),
    keys: Sequence[str] = ("city", "month"),
    brand: str = "brand",
) -> DataFrame:
    """Client, competitor and per-brand monthly metrics from one pass over the activity table.

    The rows are first reduced to (key, brand) and that small table is stored; everything else is
    read off it.
    """
    aggregates = [F.coalesce(F.sum(c), F.lit(0)).alias(o) for o, c in sums.items()]
    aggregates += [F.count(c).alias(o) for o, c in counts.items()]
    base = spill(ads.na.drop(subset=list(keys)).groupBy(*keys, brand).agg(*aggregates), "monthly")
    mine = F.col(brand).eqNullSafe(F.lit(client))
    sided = [
        F.coalesce(F.sum(F.when(test, F.col(m))), F.lit(0)).alias(f"{side}_{m}")
        for side, test in (("client", mine), ("competitor", ~mine))
        for m in [*sums, *counts]
    ]
    totals = base.groupBy(*keys).agg(*sided)
    if not brands:
        return totals
    per_brand = brand_pivot(base, brands, {m: m for m in sums}, keys, brand)
    return totals.join(per_brand, list(keys), "left").na.fill(0)


def monthly_to_weekly(
    monthly: DataFrame,
    years: DataFrame,
    metrics: Sequence[str],
    month: str = "month",
    year: str = "year",
) -> DataFrame:
    """Spread monthly values evenly over the weeks assigned to the month.

    A monthly table without a year is repeated for every year of ``years``; with a year it is
    matched on it. The calendar has at most 53 rows per year, so it is broadcast.
    """
    calendar = F.broadcast(week_calendar(years, year))
    keys = [month, year] if year in monthly.columns else [month]
    calendar = calendar.withColumnRenamed("month", month).withColumnRenamed("year", year)
    spread = monthly.join(calendar, keys)
    split = set(metrics)
    kept = [c for c in spread.columns if c not in (month, "weeks_in_month")]
    return spread.selectExpr(*[f"`{c}` / weeks_in_month as `{c}`" if c in split else f"`{c}`" for c in kept])


def keep_known(df: DataFrame, known: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Rows whose key occurs in ``known``."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_semi")


def join_panel(
    visits: DataFrame,
    weekly: Sequence[DataFrame],
    keys: Sequence[str] = ("city", "year", "week"),
    fill: Sequence[str] | None = None,
) -> DataFrame:
    """Left-join weekly activity tables onto the visits and set missing activity to 0."""
    out = visits
    for table in weekly:
        out = out.join(table, list(keys), "left")
    added = [c for c in out.columns if c not in visits.columns]
    wanted = added if fill is None else [c for c in fill if c in out.columns]
    return out.na.fill(0, subset=wanted) if wanted else out


def build_panel(
    visits: DataFrame,
    ads: DataFrame,
    client: str,
    sums: Mapping[str, str],
    counts: Mapping[str, str],
    brands: Sequence[str] = (),
    years: DataFrame | None = None,
) -> DataFrame:
    """Weekly panel: visits with client, competitor and per-brand activity.

    ``years`` (year) spares deriving the calendar's years from visits that are costly to build.
    """
    wide = monthly_wide(ads, client, sums, counts, brands)
    metrics = [c for c in wide.columns if c not in ("city", "month")]
    weekly = monthly_to_weekly(wide, (visits if years is None else years).select("year"), metrics)
    return join_panel(visits, [weekly])


def top_brands(df: DataFrame, brand: str = "brand", limit: int = 5) -> DataFrame:
    """Most frequent brands; the name breaks ties."""
    counts = df.filter(F.col(brand).isNotNull()).groupBy(brand).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(brand)).limit(limit)
