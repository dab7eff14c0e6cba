"""Lookups of small rule tables, as literals where small and as joins where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.rules import RuleBook, string_map
from feedcore.schema import LINK

#: A lookup side is broadcast up to this many rows; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 100_000

#: Longest piece of a fragment that keys a trust rule in ``trust_join``.
MAX_GRAM = 5


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting that the side is small; else leave it to Spark."""
    small = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def migrate_category(category: Column, rules: RuleBook) -> Column:
    """New name of a renamed category, any other as it is."""
    if not rules.migration:
        return category
    return F.coalesce(F.element_at(string_map(rules.migration), category), category)


def migrate_allowed(df: DataFrame, rules: RuleBook) -> DataFrame:
    """Rename old categories and keep rows of allowed ones."""
    return df.withColumn("category", migrate_category(F.col("category"), rules)).where(
        F.col("category").isin(*rules.allowed)
    )


def allowed_only(df: DataFrame, allowed: DataFrame, column: str = "category") -> DataFrame:
    """The same membership test against a table of categories."""
    return df.join(broadcast_if_small(allowed.select(column)), column, "left_semi")


def links_of(category: Column, rules: RuleBook) -> Column:
    """Official links of a category; an empty array for an unknown one."""
    result = F.array().cast(f"array<{LINK.simpleString()}>")
    for name, links in rules.official_links.items():
        found = F.array(
            *[F.struct(F.lit(label).alias("label"), F.lit(url).alias("url")) for label, url in links]
        )
        result = F.when(category == name, found).otherwise(result)
    return result


def join_official_links(df: DataFrame, links: DataFrame, column: str = "category") -> DataFrame:
    """Add ``official`` from a table ``(category, pos, label, url)``."""
    per_category = links.groupBy(F.col("category").alias(column)).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "label", "url"))),
            lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url")),
        ).alias("_links")
    )
    empty = F.array().cast(f"array<{LINK.simpleString()}>")
    return (
        df.join(broadcast_if_small(per_category), column, "left")
        .withColumn("official", F.coalesce(F.col("_links"), empty))
        .drop("_links")
    )


def display_code(category: Column, rules: RuleBook) -> Column:
    """Short display code of a category; empty for an unknown one."""
    return F.coalesce(F.element_at(string_map(rules.codes), category), F.lit(""))


def trust_join(
    df: DataFrame,
    trust: DataFrame,
    key: str,
    url: str = "url",
    default: int = 30,
) -> DataFrame:
    """Trust score and name from a rule table of any size.

    A rule matches if its fragment is anywhere in the lower-cased URL (an empty one
    matches all); the lowest ``prio`` wins, then the smaller fragment.  Instead of
    testing every URL against every rule, a rule is keyed by the first characters of
    its fragment (up to ``MAX_GRAM``) and a URL by its pieces of the lengths that
    occur, so candidates meet in an equi-join and are then checked in full.
    ``key`` must be unique per row.
    """
    told = F.struct("prio", "fragment", "score", "name")
    free = trust.where("fragment = ''").agg(F.min(told).alias("rule")).first().rule
    rules = trust.where(F.length("fragment") > 0).select(told.alias("_rule"))
    gram = F.substring("_rule.fragment", 1, MAX_GRAM)
    keyed_rules = rules.withColumn("_gram", gram)
    sizes = [r.n for r in keyed_rules.select(F.length("_gram").alias("n")).distinct().collect()]  # MAX_GRAM at most
    small = rules.count() <= MAX_BROADCAST_ROWS
    lowered = F.lower(F.coalesce(F.col(url), F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("_url"), F.lit(1)))
    cuts = F.array_distinct(
        F.flatten(F.transform(starts, lambda s: F.array(*[F.substr("_url", s, F.lit(n)) for n in sizes])))
        if sizes
        else F.array().cast("array<string>")
    )
    # A URL has each piece once; only pieces that key a rule are carried on.
    pieces = df.select(F.col(key), lowered.alias("_url")).select(key, "_url", F.explode(cuts).alias("_gram"))
    # Partial aggregation runs right after the join: a URL's pieces share a task,
    # so at most one row per URL reaches the shuffle.
    best = (
        pieces.join(F.broadcast(keyed_rules) if small else keyed_rules, "_gram")
        .where(F.contains("_url", F.col("_rule.fragment")))
        .groupBy(key)
        .agg(F.min("_rule").alias("_best"))
    )
    kind = best.schema["_best"].dataType.simpleString()
    other = F.lit(None) if free is None else F.struct(*[F.lit(v).alias(n) for n, v in free.asDict().items()])
    found = F.least(F.col("_best"), other.cast(kind))
    scored = df.join(best, key, "left").withColumn("_best", found)
    return (
        scored.withColumn("trust_name", F.col("_best.name"))
        .withColumn("trust", F.coalesce(F.col("_best.score"), F.lit(default)))
        .drop("_best")
    )
