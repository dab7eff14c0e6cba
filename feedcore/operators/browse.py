"""Read-side queries over a published feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedcore.functions.matching import is_official
from feedcore.functions.summary import page_summary
from feedcore.operators.rank import newest_first
from feedcore.rules import RuleBook

# The category choice that means all of them.
ALL = "전체"


def feed_filter(
    df: DataFrame,
    category: str | None = None,
    text: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Rows of a category with a text in title or source, in a date range.

    The text is case-sensitive; bounds are inclusive and compare as text; an
    empty argument filters nothing.
    """
    out = df
    if category and category != ALL:
        out = out.where(F.col("category") == category)
    wanted = (text or "").strip()
    if wanted:
        out = out.where(
            F.contains(F.col("title"), F.lit(wanted))
            | F.contains(F.coalesce(F.col("source"), F.lit("")), F.lit(wanted))
        )
    # Plain comparisons reach the Parquet scan; a missing date comes before any other.
    day = F.col("date")
    if date_from:
        out = out.where(day >= date_from)
    if date_to:
        out = out.where(day.isNull() | (day <= date_to))
    return out


def feed_search(df: DataFrame, rules: RuleBook, **filters: str | None) -> DataFrame:
    """Filtered rows, newest first, with the wording shown to readers (made after the sort)."""
    official = is_official(F.col("source_type"), rules)
    return newest_first(feed_filter(df, **filters), rules).withColumn(
        "page_summary",
        page_summary(F.col("title"), F.col("category"), F.col("source"), official, rules),
    )


def search_count(df: DataFrame, **filters: str | None) -> DataFrame:
    return feed_filter(df, **filters).agg(F.count("*").alias("n"))


def count_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"))


def dashboard_stats(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Totals over all items: rows, official, other, categories present.

    Rows are first counted per category, so the distinct count reads a handful
    of rows instead of making Spark expand the input.
    """
    official = is_official(F.col("source_type"), rules)
    per_category = df.groupBy("category").agg(
        F.count("*").alias("rows"), F.count_if(official).alias("official_rows")
    )
    return per_category.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("official_rows"), F.lit(0)).alias("official"),
        F.coalesce(F.sum(F.col("rows") - F.col("official_rows")), F.lit(0)).alias("other"),
        F.count("*").alias("categories"),
    )
