"""Feed order and bounded top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedcore.functions.matching import is_official
from feedcore.rules import RuleBook
from feedcore.schema import intake_order

#: Most rows that may be packed into one row or numbered in one task.
MAX_TOP = 100_000


def feed_order(rules: RuleBook) -> list[Column]:
    """Most trusted first, newest first, official before others, then intake order.

    The last part is what a stable sort leaves of the order in which rows were merged.
    """
    return [
        F.coalesce(F.col("trust"), F.lit(rules.default_trust)).desc(),
        F.coalesce(F.col("date"), F.lit("")).desc(),
        is_official(F.col("source_type"), rules).desc(),
        *intake_order(),
    ]


def rank_feed(df: DataFrame, rules: RuleBook) -> DataFrame:
    """The whole feed in published order: a range-partitioned sort."""
    return df.orderBy(*feed_order(rules))


def newest_first(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Latest date first, ties in published order."""
    return df.orderBy(F.coalesce(F.col("date"), F.lit("")).desc(), *feed_order(rules))


def top(df: DataFrame, order: list[Column], n: int, position: str = "position") -> DataFrame:
    """First ``n`` rows with their position, numbered after the cut."""
    if n > MAX_TOP:
        raise ValueError(f"a numbered list holds at most {MAX_TOP} rows; write the ranked table instead")
    cut = df.orderBy(*order).limit(n)
    return cut.withColumn(position, F.row_number().over(Window.orderBy(*order)))
