"""From captured responses to items of one run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.functions.matching import is_official_on_reload
from feedcore.functions.urls import with_trust
from feedcore.operators.lookup import links_of, migrate_category
from feedcore.operators.profile import BROKEN, NO_ANSWER
from feedcore.rules import RuleBook
from feedcore.schema import STORED, conform
from feedcore.sources import scan
from feedcore.sources.payload import accepted, best_attempts, contested_requests
from feedcore.sources.readers import WIRED, Source


def ingest(
    raw: DataFrame,
    rules: RuleBook,
    as_of: dt.date | str,
    run: int,
    sources: Sequence[Source] = WIRED,
    strict_reference: bool = False,
) -> DataFrame:
    """Items of all sources, each with its place in the intake order.

    Optional sources leave type and trust open and use two old category names.
    They are filled in and renamed here unless ``strict_reference`` is set, in
    which case such rows pass through as they are.
    """
    parts = []
    contested = contested_requests(raw.where(F.col("source").isin(*[s.name for s in sources])))
    for rank, source in enumerate(sources):
        mine = raw.where(F.col("source") == source.name)
        items = source.read(best_attempts(mine, source.needs_xml, contested), rules, as_of)
        fill = not (source.complete or strict_reference)
        if fill:
            items = items.withColumn("category", migrate_category(F.col("category"), rules))
        items = items.withColumns(
            {
                "run_seq": F.lit(run).cast("long"),
                "source_rank": F.lit(rank),
                "official": links_of(F.col("category"), rules),
            }
        )
        parts.append(conform(fill_missing(items, rules) if fill else items, STORED))
    return reduce(DataFrame.unionByName, parts)


def fill_missing(items: DataFrame, rules: RuleBook) -> DataFrame:
    """Links, type and trust where absent; present values stay."""
    official = is_official_on_reload(F.col("source"), F.col("source_type"), rules)
    scored = with_trust(items.withColumn("_official", official), rules, "url", "_score")
    return scored.withColumns(
        {
            "official": F.coalesce(F.col("official"), links_of(F.col("category"), rules)),
            "source_type": F.coalesce(
                F.col("source_type"),
                F.when(F.col("_official"), F.lit(rules.official_type)).otherwise(F.lit(rules.news_type)),
            ),
            "trust": F.coalesce(
                F.col("trust"),
                F.when(F.col("_official"), F.lit(rules.official_trust)).otherwise(F.col("_score")),
            ),
        }
    ).drop("_official", "_score")


def _is_broken(content: str, body: Column) -> Column:
    parse = {"rss": scan.parse_rss, "law": scan.parse_laws, "news": scan.parse_news}.get(content)
    if parse is None:
        return F.lit(False)
    return F.coalesce(body != "", F.lit(False)) & parse(body)["_corrupt"].isNotNull()


def request_outcomes(raw: DataFrame, sources: Sequence[Source] = WIRED) -> DataFrame:
    """One row per request: ``failure`` is null, ``no answer`` or ``broken payload``.

    Payloads are judged where they are read; only flags and ids are shuffled.
    """
    parts = []
    for source in sources:
        mine = raw.where(F.col("source") == source.name)
        judged = mine.select(
            "request_id",
            F.col("source"),
            "category",
            F.when(
                accepted(source.needs_xml),
                F.struct("attempt_rank", "payload_id", _is_broken(source.content, F.col("body")).alias("broken")),
            ).alias("used"),
        )
        parts.append(judged)
    per_request = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("request_id", "source", "category")
        .agg(F.min("used").alias("used"))
    )
    return per_request.select(
        "request_id",
        "source",
        "category",
        F.when(F.col("used").isNull(), F.lit(NO_ANSWER))
        .when(F.col("used.broken"), F.lit(BROKEN))
        .alias("failure"),
    )
