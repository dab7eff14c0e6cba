"""Keyword filters, classification and source trust over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.catalog.registry import any_of, query, table
from feedcore.catalog.views import (
    ITEMS,
    TRIAL,
    classify_sql,
    exclude_sql,
    items,
    match_sql,
    trust_sql,
)
from feedcore.functions import matching
from feedcore.functions.urls import with_trust
from feedcore.operators import lookup
from feedcore.rules import trust_frame


def _kept(spark: SparkSession, folder: str, test: Column) -> DataFrame:
    return items(spark, folder).where(test).select("doc_id", "pos", "title")


def _kept_sql(test: str) -> str:
    return f"WITH {ITEMS} SELECT doc_id, pos, title FROM items WHERE {test}"


@query(_kept_sql(f"NOT {any_of('title', TRIAL.regulator_exclude)}"))
def exclude_hints(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, ~matching.any_contains(F.col("title"), TRIAL.regulator_exclude))


@query(_kept_sql(f"NOT {any_of('title', TRIAL.noise)}"))
def noise_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, ~matching.is_noise(F.col("title"), TRIAL))


@query(_kept_sql(f"NOT ({any_of('title', TRIAL.ads)} OR {any_of('source', TRIAL.low_quality_sources)})"))
def ad_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, ~matching.is_ad(F.col("title"), TRIAL, F.col("source")))


@query(
    f"""WITH {ITEMS} SELECT doc_id, pos, {exclude_sql('title', TRIAL, 'source')} AS with_outlet,
          {exclude_sql('title', TRIAL)} AS title_only FROM items"""
)
def should_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select(
        "doc_id",
        "pos",
        matching.should_exclude(F.col("title"), TRIAL, F.col("source")).alias("with_outlet"),
        matching.should_exclude(F.col("title"), TRIAL).alias("title_only"),
    )


@query(_kept_sql(any_of("title", TRIAL.ministry_keywords)))
def keyword_include(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, matching.any_contains(F.col("title"), TRIAL.ministry_keywords))


@query(_kept_sql(match_sql("title", "category")))
def match_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, matching.match_strict(F.col("title"), F.col("category"), TRIAL))


@query(_kept_sql(match_sql("title", "category", strict=False)))
def match_loose(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, matching.match_loose(F.col("title"), F.col("category"), TRIAL))


@query(
    f"""WITH {ITEMS}, c AS (SELECT doc_id, pos, {classify_sql('title', TRIAL.regulator_rules)} AS class FROM items)
    SELECT * FROM c WHERE class IS NOT NULL"""
)
def classify_ordered(spark: SparkSession, folder: str) -> DataFrame:
    found = matching.classify_ordered(F.col("title"), TRIAL.regulator_rules)
    return (
        items(spark, folder)
        .select("doc_id", "pos", found.alias("class"))
        .where(F.col("class").isNotNull())
    )


_STRICT_CLASS = (
    "CASE "
    + " ".join(
        f"WHEN {any_of('title', r.must)} AND {any_of('title', r.combine)} THEN '{r.category}'"
        for r in TRIAL.categories
    )
    + " END"
)


@query(f"WITH {ITEMS} SELECT doc_id, pos, {_STRICT_CLASS} AS class FROM items")
def classify_strict(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select(
        "doc_id", "pos", matching.classify_strict(F.col("title"), TRIAL).alias("class")
    )


@query(
    f"""WITH {ITEMS}, u AS (SELECT page_id AS id, 'page' AS kind, url FROM pages
          UNION ALL SELECT doc_id * 100000 + pos, 'item', url FROM items)
    SELECT id, kind, {trust_sql('url')} AS trust FROM u"""
)
def trust_score(spark: SparkSession, folder: str) -> DataFrame:
    return with_trust(_urls(spark, folder), TRIAL, "url", "trust").select("id", "kind", "trust")


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url"
    )
    found = items(spark, folder).select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.lit("item").alias("kind"), "url"
    )
    return pages.unionByName(found)


@query(
    f"""SELECT page_id, coalesce({trust_sql('url', what='name')}, 'press ' || page_id) AS outlet,
          {trust_sql('url', what='name')} IS NULL AS unknown FROM pages"""
)
def trust_name(spark: SparkSession, folder: str) -> DataFrame:
    named = with_trust(table(spark, folder, "pages"), TRIAL, "url", None, "trusted")
    press = F.concat(F.lit("press "), F.col("page_id").cast("string"))
    return named.select(
        "page_id",
        F.coalesce(F.col("trusted"), press).alias("outlet"),
        F.col("trusted").isNull().alias("unknown"),
    )


@query(
    f"""WITH {ITEMS} SELECT doc_id * 100000 + pos AS id, {trust_sql('url')} AS trust,
          {trust_sql('url', what='name')} AS trust_name FROM items"""
)
def trust_join(spark: SparkSession, folder: str) -> DataFrame:
    found = items(spark, folder).select((F.col("doc_id") * 100000 + F.col("pos")).alias("id"), "url")
    scored = lookup.trust_join(found, trust_frame(spark, TRIAL), "id", default=TRIAL.default_trust)
    return scored.select("id", "trust", "trust_name")
