"""Effective dates: the month grid and the upcoming list."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.functions.dates import EFFECTIVE_WORD, day, days_until, effective_date, months_later
from feedcore.functions.text import settle, short_name
from feedcore.operators.lookup import display_code
from feedcore.rules import RuleBook

# Length of the upcoming list, its horizon, and what counts as soon.
UPCOMING_ROWS = 6
UPCOMING_MONTHS = 3
SOON_DAYS = 30


def enforcement_events(df: DataFrame, rules: RuleBook, keep: list[str] | None = None) -> DataFrame:
    """Items whose title names an effective date: date, short name, category, code.

    A text such as 30 February is no calendar day and gives no event.
    """
    dated = settle(
        df.where(F.contains(F.col("title"), F.lit(EFFECTIVE_WORD))).withColumn(
            "eff_date", effective_date(F.col("title"))
        ),
        "eff_date",
    ).where(F.col("eff_date").isNotNull())
    return dated.select(
        "eff_date",
        short_name(F.col("title")).alias("name"),
        "category",
        display_code(F.col("category"), rules).alias("code"),
        *(keep or []),
    )


def month_days(spark: SparkSession, year: int, month: int, as_of: dt.date | str) -> DataFrame:
    """One row per day of a month, with its place in a Sunday-first grid."""
    first = day(dt.date(year, month, 1))
    days = spark.range(1).select(
        F.explode(F.sequence(first, F.last_day(first))).alias("eff_date")
    )
    return days.select(
        "eff_date",
        F.dayofmonth("eff_date").alias("day"),
        (F.dayofweek(first) - 1 + F.dayofmonth("eff_date") - 1).alias("cell"),
        (F.col("eff_date") == day(as_of)).alias("is_today"),
    )


def month_calendar(
    events: DataFrame, year: int, month: int, as_of: dt.date | str
) -> DataFrame:
    """Month grid with the distinct codes of each day's events.

    Events are cut to the month and reduced to distinct (day, code) before they
    meet the grid, so a day with a third of all events costs a few rows.
    """
    first = dt.date(year, month, 1)
    in_month = (F.col("eff_date") >= day(first)) & (F.col("eff_date") <= F.last_day(day(first)))
    dots = (
        events.where(in_month)
        .select("eff_date", "code")
        .distinct()
        .groupBy("eff_date")
        .agg(F.array_sort(F.collect_list("code")).alias("codes"))
    )
    empty = F.array().cast("array<string>")
    grid = month_days(events.sparkSession, year, month, as_of)
    return grid.join(dots, "eff_date", "left").withColumn(
        "codes", F.coalesce(F.col("codes"), empty)
    )


def upcoming(
    events: DataFrame, as_of: dt.date | str, order: list[Column], n: int = UPCOMING_ROWS
) -> DataFrame:
    """Next events within three months, nearest first, with days to go."""
    today = day(as_of)
    soon = F.col("eff_date").between(today, months_later(today, UPCOMING_MONTHS))
    cut = events.where(soon).orderBy(F.col("eff_date"), *order).limit(n)
    return cut.withColumn("days_left", days_until(F.col("eff_date"), today)).withColumn(
        "soon", F.col("days_left") <= SOON_DAYS
    )
