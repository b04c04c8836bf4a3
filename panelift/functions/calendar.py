"""Week calendar: weeks 1..53 of a year, each assigned to one month.

Week 1 starts on the next Monday when 1 January is a Tuesday, Wednesday or Thursday; otherwise on
the Monday on or before 1 January (this is not the ISO rule). A week belongs to the month that
holds most of its days inside the year, the earlier month on a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKS = 53


def first_week_start(year: Column) -> Column:
    january = F.make_date(year, F.lit(1), F.lit(1))
    weekday = F.weekday(january)
    return F.date_add(january, F.when(weekday.isin(1, 2, 3), 7 - weekday).otherwise(-weekday))


def week_number(day: Column) -> Column:
    """Week of the day's own year; values outside 1..53 belong to no week."""
    return (F.floor(F.datediff(day, first_week_start(F.year(day))) / 7) + 1).cast("int")


def week_calendar(years: DataFrame, year: str = "year") -> DataFrame:
    """(year, week, month, weeks_in_month) for each distinct year of the input: at most 53 rows per year.

    Years that Spark's dates cannot hold raise an error in ANSI mode; a missing year has no weeks.
    """
    from pyspark.sql import Window

    weeks = (
        years.select(F.col(year).cast("int").alias("year"))
        .filter(F.col("year").isNotNull())
        .distinct()
        .select("year", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))).alias("week"))
        .withColumn("_start", F.date_add(first_week_start(F.col("year")), (F.col("week") - 1) * 7))
        .filter(F.year("_start") <= F.col("year"))
    )
    low = F.greatest("_start", F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    high = F.least(F.date_add("_start", 6), F.make_date(F.col("year"), F.lit(12), F.lit(31)))
    middle = F.date_add(low, F.floor(F.datediff(high, low) / 2).cast("int"))
    assigned = weeks.select("year", "week", F.month(middle).alias("month"))
    per_month = Window.partitionBy("year", "month")
    return assigned.withColumn("weeks_in_month", F.count(F.lit(1)).over(per_month))
