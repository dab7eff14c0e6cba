"""First-wins de-duplication and caps.

``row_number() <= n`` lets Spark keep at most ``n`` rows per key in every map
task before the shuffle (``WindowGroupLimit``), so a key that holds a third of
all rows sends no more than ``n`` rows per task.  ``dropDuplicates`` would not
promise which copy survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedcore.functions.matching import is_official
from feedcore.functions.text import settle, title_key
from feedcore.rules import RuleBook
from feedcore.schema import intake_order


def first_per_key(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """First ``n`` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def title_dedup(df: DataFrame, order: Sequence[Column] | None = None, title: str = "title") -> DataFrame:
    """One row per title key; rows whose title has no key are dropped."""
    keyed = settle(df.withColumn("_key", title_key(F.col(title))), "_key").where(F.col("_key") != "")
    return first_per_key(keyed, ["_key"], order or intake_order()).drop("_key")


def exact_dedup(
    df: DataFrame, keys: Sequence[str] = ("title", "date"), order: Sequence[Column] | None = None
) -> DataFrame:
    """One row per exact combination of the key columns; null counts as empty."""
    exprs = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return first_per_key(df, exprs, order or intake_order())


FEED_KEY = ["_official", "_key", "_day"]


def with_feed_key(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Add the columns of ``FEED_KEY``; rows that have no key are dropped.

    Official rows are keyed by (title, date), all others by title key.  The two
    kinds never shadow each other: the split is part of the key.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    official = F.col("_official")
    keyed = (
        df.withColumn("_official", is_official(F.col("source_type"), rules))
        .withColumn("_key", F.when(official, title).otherwise(title_key(title)))
        .withColumn(
            "_day", F.when(official, F.coalesce(F.col("date"), F.lit(""))).otherwise(F.lit(""))
        )
    )
    return settle(keyed, *FEED_KEY).where(official | (F.col("_key") != ""))


def feed_dedup(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Both kinds of row de-duplicated by their own key, in one shuffle."""
    return first_per_key(with_feed_key(df, rules), FEED_KEY, intake_order()).drop(*FEED_KEY)


def cap(df: DataFrame, by: Sequence[str], n: int, order: Sequence[Column] | None = None) -> DataFrame:
    """First ``n`` rows per group in feed order."""
    return first_per_key(df, list(by), order or [F.col("feed_pos")], n)


def new_only(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the stored set.

    Stored keys are made distinct before the shuffle, so a key stored a billion
    times is one row per task; a key that is hot on the left is split by AQE.
    """
    return df.join(stored.select(key).distinct(), key, "left_anti")
