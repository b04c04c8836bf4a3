from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelift.functions.calendar import week_calendar, week_number
from panelift.operators import panel


def months_by_counting(year):
    """Week to month by counting days, the long way."""
    start = date(year, 1, 1)
    weekday = start.weekday()
    start += timedelta(days=7 - weekday if weekday in (1, 2, 3) else -weekday)
    out = {}
    for week in range(1, 54):
        if start.year > year:
            break
        days = [d for d in (start + timedelta(days=i) for i in range(7)) if d.year == year]
        counts = {}
        for d in days:
            counts[d.month] = counts.get(d.month, 0) + 1
        if counts:
            out[week] = max(counts, key=counts.get)
        start += timedelta(days=7)
    return out


def test_calendar_for_many_years(spark):
    years = list(range(1990, 2045))
    rows = week_calendar(spark.createDataFrame([(y,) for y in years], "year int")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.year, {})[r.week] = r.month
    assert got == {y: months_by_counting(y) for y in years}


def test_weeks_per_month_2023(spark):
    cal = week_calendar(spark.createDataFrame([(2023,)], "year int")).select("month", "weeks_in_month").distinct().orderBy("month")
    assert [r.weeks_in_month for r in cal.collect()] == [5, 4, 5, 4, 4, 5, 4, 5, 4, 4, 5, 4]


def test_week_number(spark):
    df = spark.createDataFrame([(date(2019, 1, 1),), (date(2019, 1, 7),), (date(2023, 1, 1),)], "d date")
    # 2019 starts on a Tuesday: its first week begins on 7 January; 2023 on a Sunday
    assert [r.w for r in df.select(week_number(F.col("d")).alias("w")).collect()] == [0, 1, 1]


@pytest.fixture()
def ads(spark):
    rows = [("A", "M", 1, 10.0, 1), ("A", "X", 1, 4.0, None), ("A", None, 1, 6.0, 1), ("B", "X", 2, 8.0, 1), (None, "X", 1, 99.0, 1), ("A", "Y", 2, None, 1)]
    return spark.createDataFrame(rows, "city string, brand string, month int, grp double, ev int")


def test_weekly_values_add_up_to_the_month(spark, ads):
    monthly = panel.monthly_totals(ads, {"grp": "grp"}, {"events": "ev"})
    weekly = panel.monthly_to_weekly(monthly, spark.createDataFrame([(2023,), (2024,)], "year int"), ["grp", "events"])
    sums = weekly.groupBy("city", "year").agg(F.sum("grp").alias("g"), F.sum("events").alias("e")).collect()
    assert {(r.city, r.year): (round(r.g, 9), round(r.e, 9)) for r in sums} == {(c, y): v for y in (2023, 2024) for c, v in {"A": (20.0, 3.0), "B": (8.0, 1.0)}.items()}


def test_a_month_with_a_year_keeps_it(spark):
    monthly = spark.createDataFrame([("A", 2023, 1, 5.0)], "city string, year int, month int, grp double")
    weekly = panel.monthly_to_weekly(monthly, spark.createDataFrame([(2023,), (2024,)], "year int"), ["grp"])
    assert weekly.count() == 5 and {r.year for r in weekly.collect()} == {2023}


def test_panel_roles(spark, ads):
    assert panel.distinct_brands(ads, "M") == ["X", "Y"]
    visits = spark.createDataFrame([("A", 2023, 1, 7), ("C", 2023, 1, 9)], "city string, year int, week int, visits int")
    out = {r.city: r for r in panel.build_panel(visits, ads, "M", {"grp": "grp"}, {"events": "ev"}, ["X", "Y"]).collect()}
    a = out["A"]
    # a missing brand is a competitor; a missing event is not counted
    assert (a.client_grp, a.competitor_grp, a.X_grp, a.Y_grp) == (2.0, 2.0, 0.8, 0.0)
    assert (a.client_events, a.competitor_events) == (0.2, 0.2)
    assert out["C"].client_grp == 0 and out["C"].X_grp == 0


def test_pivot_with_odd_brand_names(spark):
    df = spark.createDataFrame([("A", 1, "it's #1", 2.0)], "city string, month int, brand string, grp double")
    assert panel.brand_pivot(df, ["it's #1"], {"grp": "grp"}).columns == ["city", "month", "it_s_1_grp"]
    with pytest.raises(ValueError):
        panel.brand_pivot(df, ["a b", "a#b"], {"grp": "grp"})
