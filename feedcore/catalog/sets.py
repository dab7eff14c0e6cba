"""De-duplication, caps, lookups and merging over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.catalog.registry import query, table, text
from feedcore.catalog.views import (
    AS_OF,
    ITEMS,
    NEWS,
    OFFICIAL,
    TRIAL,
    classify_sql,
    exclude_sql,
    items,
    key_sql,
    links_sql,
    links_text,
    match_sql,
    trust_sql,
)
from feedcore.functions import matching
from feedcore.functions.text import title_key
from feedcore.functions.urls import with_trust
from feedcore.operators import first, lookup, rank
from feedcore.plans import merge
from feedcore.rules import links_frame
from feedcore.session import shared_folder
from feedcore.sources import store
from feedcore.sources.json_array import write_arrays

ITEM_SHOWN = ["title", "source", "source_type", "category", "date"]
_FIRST = f"""firsts AS (
  SELECT * FROM (
    SELECT *, {key_sql('title')} AS k FROM items WHERE {key_sql('title')} <> ''
  ) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1)"""


@query(f"WITH {ITEMS}, {_FIRST} SELECT doc_id, pos, title FROM firsts")
def title_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return first.title_dedup(items(spark, folder)).select("doc_id", "pos", "title")


@query(
    f"""WITH {ITEMS} SELECT doc_id, pos, title, date FROM items
    QUALIFY row_number() OVER (PARTITION BY title, date ORDER BY doc_id, pos) = 1"""
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return first.exact_dedup(items(spark, folder)).select("doc_id", "pos", "title", "date")


@query(
    """SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 8"""
)
def cap_per_category(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return first.cap(events, ["user_id", "event_type"], TRIAL.portal_cap, [F.col("event_id")]).select(
        "event_id", "user_id", "event_type", "value"
    )


@query(
    f"""WITH {ITEMS}, keyed AS (SELECT *, {key_sql('title')} AS k FROM items)
    SELECT doc_id, pos, title FROM keyed
    WHERE lang_of_day = 'new' AND k NOT IN (SELECT k FROM keyed WHERE lang_of_day = 'stored')""".replace(
        "lang_of_day", "(CASE WHEN date >= '2024-10-01' THEN 'new' ELSE 'stored' END)"
    )
)
def new_only(spark: SparkSession, folder: str) -> DataFrame:
    keyed = items(spark, folder).withColumn("k", title_key(F.col("title")))
    new = keyed.where(F.col("date") >= "2024-10-01")
    stored = keyed.where(F.col("date") < "2024-10-01")
    return first.new_only(new, stored, "k").select("doc_id", "pos", "title")


_MIGRATED = "CASE WHEN category = 'es' THEN 'fr' ELSE category END"


@query(
    f"""WITH {ITEMS}, named AS (
      SELECT doc_id, pos, CASE WHEN source = 'src19' THEN 'other' ELSE {_MIGRATED} END AS category FROM items)
    SELECT * FROM named WHERE category IN ('en', 'fr', 'de')"""
)
def migrate_allowed(spark: SparkSession, folder: str) -> DataFrame:
    named = items(spark, folder).select(
        "doc_id",
        "pos",
        F.when(F.col("source") == "src19", F.lit("other")).otherwise(F.col("category")).alias("category"),
    )
    allowed = spark.createDataFrame([(c,) for c in TRIAL.allowed], "category string")
    renamed = named.withColumn("category", lookup.migrate_category(F.col("category"), TRIAL))
    return lookup.allowed_only(renamed, allowed).select("doc_id", "pos", "category")


@query(f"WITH {ITEMS} SELECT doc_id, pos, category, {links_sql('category')} AS links FROM items")
def official_links(spark: SparkSession, folder: str) -> DataFrame:
    found = items(spark, folder).select("doc_id", "pos", "category")
    joined = lookup.join_official_links(found, links_frame(spark, TRIAL))
    return joined.select("doc_id", "pos", "category", links_text().alias("links"))


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Items as an old run may have stored them: some without type, trust or links."""
    found = items(spark, folder)
    return found.withColumns(
        {
            "source_type": F.when(F.col("pos") % 2 == 0, F.col("source_type")),
            "trust": F.when(F.col("doc_id") % 5 == 0, F.lit(77)),
            "official": F.when(
                F.col("doc_id") % 7 == 0,
                F.array(F.struct(F.lit("Kept").alias("label"), F.lit("https://kept/").alias("url"))),
            ),
        }
    )


GAPPY = f"""{ITEMS}, gappy AS (
  SELECT doc_id, pos, source, category, title, url, date,
    CASE WHEN pos % 2 = 0 THEN source_type END AS source_type,
    CASE WHEN doc_id % 5 = 0 THEN 77 END AS trust,
    CASE WHEN doc_id % 7 = 0 THEN 'Kept=https://kept/' END AS links
  FROM items)"""

_IS_OFFICIAL = f"(source IN ('src3', 'src7') OR coalesce(source_type = {text(OFFICIAL)}, FALSE))"

REVALIDATED = f"""{GAPPY},
named AS (SELECT * REPLACE ({_MIGRATED} AS category) FROM gappy),
revalidated AS (
  SELECT doc_id, pos, source, category, title, url, date,
    coalesce(source_type, CASE WHEN {_IS_OFFICIAL} THEN {text(OFFICIAL)} ELSE {text(NEWS)} END) AS source_type,
    coalesce(trust, CASE WHEN {_IS_OFFICIAL} THEN 100 ELSE {trust_sql('url')} END) AS trust,
    coalesce(links, {links_sql('category')}) AS links
  FROM named
  WHERE category IN ('en', 'fr', 'de')
    AND ({_IS_OFFICIAL} OR (NOT {exclude_sql('title')} AND {match_sql('title', 'category')})))"""


@query(f"WITH {REVALIDATED} SELECT doc_id, pos, category, source_type, trust, links FROM revalidated")
def stored_revalidate(spark: SparkSession, folder: str) -> DataFrame:
    return merge.revalidate(gappy(spark, folder), TRIAL).select(
        "doc_id", "pos", "category", "source_type", "trust", links_text().alias("links")
    )


_CUTOFF = "strftime(DATE '2024-12-31' - 180, '%Y-%m-%d')"


@query(
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders
    WHERE o_orderstatus = 'F' OR strftime(o_orderdate, '%Y-%m-%d') >= strftime(DATE '2000-06-30' - 180, '%Y-%m-%d')"""
)
def retention(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lit(OFFICIAL)).otherwise(F.lit(NEWS)).alias("source_type"),
    )
    return orders.where(merge.retained(TRIAL, "2000-06-30")).select("o_orderkey", "date")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return with_trust(items(spark, folder), TRIAL)


SCORED = f"{ITEMS}, scored AS (SELECT *, {trust_sql('url')} AS trust FROM items)"

FEED_ORDER = (
    f"trust DESC, date DESC, (source_type = {text(OFFICIAL)}) DESC, doc_id, pos"
)


@query(f"WITH {SCORED} SELECT doc_id, pos, trust, date FROM scored ORDER BY {FEED_ORDER}")
def rank_feed(spark: SparkSession, folder: str) -> DataFrame:
    return rank.rank_feed(scored(spark, folder), TRIAL).select("doc_id", "pos", "trust", "date")


_FLAGSHIP = f"""{ITEMS},
  classed AS (SELECT *, {classify_sql('title', TRIAL.regulator_rules)} AS class FROM items),
  keyed AS (SELECT *, {key_sql('title')} AS k FROM classed WHERE class IS NOT NULL),
  firsts AS (SELECT *, {trust_sql('url')} AS trust FROM keyed WHERE k <> ''
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1)"""


@query(
    f"""WITH {_FLAGSHIP}
    SELECT CAST(row_number() OVER (ORDER BY {FEED_ORDER}) AS INTEGER) AS position,
           doc_id, pos, class, title, trust, date
    FROM firsts QUALIFY position <= 100"""
)
def feed_flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Classify every line, keep the first of each title, score, and list the top 100."""
    classed = (
        items(spark, folder)
        .withColumn("class", matching.classify_ordered(F.col("title"), TRIAL.regulator_rules))
        .where(F.col("class").isNotNull())
    )
    ranked = rank.top(
        with_trust(first.title_dedup(classed), TRIAL), rank.feed_order(TRIAL), 100
    )
    return ranked.select("position", "doc_id", "pos", "class", "title", "trust", "date")


def _impact_sql() -> str:
    return "list_sum(list_transform(string_split(substr(title, 1, 10), ''), lambda c: unicode(c)))"


# Even documents are new, odd ones stored.  Stored rows keep document order too.
MERGED = f"""{REVALIDATED},
fresh AS (
  SELECT doc_id, pos, source, category, title, url, date, source_type,
    CASE WHEN source_type = {text(OFFICIAL)} THEN 100 ELSE {trust_sql('url')} END AS trust,
    {links_sql('category')} AS links, 0 AS generation
  FROM items WHERE doc_id % 2 = 0 AND category IN ('en', 'fr', 'de')),
united AS (
  SELECT * FROM fresh
  UNION ALL BY NAME SELECT *, 1 AS generation FROM revalidated WHERE doc_id % 2 = 1),
keyed AS (
  SELECT *, source_type = {text(OFFICIAL)} AS is_off,
    CASE WHEN source_type = {text(OFFICIAL)} THEN title ELSE {key_sql('title')} END AS k1,
    CASE WHEN source_type = {text(OFFICIAL)} THEN date ELSE '' END AS k2
  FROM united),
merged AS (
  SELECT * FROM (
    SELECT * FROM keyed WHERE is_off OR k1 <> ''
    QUALIFY row_number() OVER (PARTITION BY is_off, k1, k2 ORDER BY generation, doc_id, pos) = 1)
  WHERE is_off OR date >= {_CUTOFF})"""


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Even documents as a new run, odd ones as the re-checked stored set."""
    fresh = items(spark, folder).where(F.col("doc_id") % 2 == 0)
    official = matching.is_official(F.col("source_type"), TRIAL)
    new = (
        with_trust(fresh.where(F.col("category").isin(*TRIAL.allowed)), TRIAL)
        .withColumn("trust", F.when(official, F.lit(TRIAL.official_trust)).otherwise(F.col("trust")))
        .withColumn("official", lookup.links_of(F.col("category"), TRIAL))
    )
    stored = merge.revalidate(gappy(spark, folder).where(F.col("doc_id") % 2 == 1), TRIAL)
    return new, stored


def merged(spark: SparkSession, folder: str) -> DataFrame:
    new, stored = halves(spark, folder)
    return merge.merge(new, stored, TRIAL, AS_OF, run=1)


@query(
    f"""WITH {MERGED}
    SELECT doc_id, pos, title, source_type, trust, date, links,
           CAST(1 - generation AS BIGINT) AS run_seq, CAST({_impact_sql()} AS BIGINT) AS seed
    FROM merged"""
)
def merge_generations(spark: SparkSession, folder: str) -> DataFrame:
    from feedcore.functions.summary import title_seed

    return merged(spark, folder).select(
        F.col("payload_id").cast("long").alias("doc_id"),
        F.col("feed_pos").alias("pos"),
        "title",
        "source_type",
        "trust",
        "date",
        links_text().alias("links"),
        "run_seq",
        title_seed(F.col("title")).cast("long").alias("seed"),
    )


@query(f"WITH {MERGED} SELECT doc_id, pos, title, source, source_type, category, url, date, trust FROM merged")
def store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Merge, write the stored set, write a second run over it, read it back."""
    path = shared_folder(spark, "store")
    new, stored = halves(spark, folder)
    none = stored.limit(0)
    # Everything is kept in the first run: its date is before all cut-offs.
    store.write_store(merge.merge(stored, none, TRIAL, "2024-01-01", run=1), path, 1, TRIAL)
    fresh, kept = merge.merge_parts(new, store.read_store(spark, path), TRIAL, AS_OF, run=2)
    store.write_store(fresh, path, 2, TRIAL, kept)
    return store.read_store(spark, path).select(
        F.col("payload_id").cast("long").alias("doc_id"),
        F.col("feed_pos").alias("pos"),
        "title",
        "source",
        "source_type",
        "category",
        "url",
        "date",
        "trust",
    )


@query(f"WITH {ITEMS} SELECT doc_id, pos, title, source, source_type, category, url, date FROM items")
def json_array_read(spark: SparkSession, folder: str) -> DataFrame:
    """All items as JSON arrays, one a partition, read back range by range."""
    path = shared_folder(spark, "arrays")
    # The link ends in the document and the line, so an item read back is known by it.
    official = F.array(F.struct(F.lit("a \\\" } ], [ {").alias("label"), F.col("url")))
    rows = items(spark, folder).withColumn("official", official)
    write_arrays(rows.select(F.to_json(F.struct(*ITEM_SHOWN, "official", "url"))), path)
    found, _ = store.read_items_json(spark, path, split=1 << 18)
    place = F.split("url", "/")
    return found.where("official[0].url = url").select(
        F.element_at(place, -2).cast("long").alias("doc_id"), F.element_at(place, -1).cast("long").alias("pos"), *ITEM_SHOWN, "url"
    )


# Three runs: a document is in one of them by its number.
_RUNS = {1: "2024-07-01", 2: "2024-10-01", 3: "2025-02-01"}


def _kept_at(*runs: int) -> str:
    tests = [f"date >= strftime(DATE '{_RUNS[n]}' - 180, '%Y-%m-%d')" for n in runs]
    return f"(is_off OR ({' AND '.join(tests)}))"


_FITS = f"(is_off OR (NOT {exclude_sql('title')} AND {match_sql('title', 'category')}))"
RUNS = f"""{ITEMS}, rows_of AS (
  SELECT *, 1 + doc_id % 3 AS run, source_type = {text(OFFICIAL)} AS is_off,
    CASE WHEN source_type = {text(OFFICIAL)} THEN title ELSE {key_sql('title')} END AS k1,
    CASE WHEN source_type = {text(OFFICIAL)} THEN date ELSE '' END AS k2,
    CASE WHEN source_type = {text(OFFICIAL)} THEN 100 ELSE {trust_sql('url')} END AS trust
  FROM items WHERE category IN ('en', 'fr', 'de')),
once AS (
  SELECT * FROM rows_of WHERE is_off OR k1 <> ''
  QUALIFY row_number() OVER (PARTITION BY run, is_off, k1, k2 ORDER BY doc_id, pos) = 1),
stored AS (
  SELECT * FROM once WHERE run = 3 AND {_kept_at(3)}
  UNION ALL SELECT * FROM once WHERE run = 2 AND {_kept_at(2, 3)} AND {_FITS}
    AND (is_off, k1, k2) NOT IN (SELECT (is_off, k1, k2) FROM once WHERE run = 3)
  UNION ALL SELECT * FROM once WHERE run = 1 AND {_kept_at(1, 2, 3)} AND {_FITS}
    AND (is_off, k1, k2) NOT IN (SELECT (is_off, k1, k2) FROM once WHERE run > 1))"""


def of_run(spark: SparkSession, folder: str, run: int) -> DataFrame:
    """The rows that come in with one of the three runs."""
    mine = items(spark, folder).where(F.col("doc_id") % 3 + 1 == run)
    official = matching.is_official(F.col("source_type"), TRIAL)
    scored = with_trust(mine.where(F.col("category").isin(*TRIAL.allowed)), TRIAL)
    return scored.withColumn("trust", F.when(official, F.lit(TRIAL.official_trust)).otherwise(F.col("trust")))


@query(
    f"""WITH {RUNS}
    SELECT doc_id, pos, title, source, source_type, category, url, date, trust, CAST(run AS BIGINT) AS run_seq FROM stored"""
)
def store_touch(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs over one store, each of which rewrites only the folders it touches."""
    path = shared_folder(spark, "touch")
    for run, as_of in _RUNS.items():
        merge.merge_touched(spark, of_run(spark, folder, run), path, TRIAL, as_of, run)
    return store.read_store(spark, path).select(
        F.col("payload_id").cast("long").alias("doc_id"),
        F.col("feed_pos").alias("pos"),
        "title",
        "source",
        "source_type",
        "category",
        "url",
        "date",
        "trust",
        "run_seq",
    )


@query(
    f"""WITH {MERGED}, top AS (
      SELECT *, row_number() OVER (ORDER BY trust DESC, date DESC, is_off DESC, generation, doc_id, pos) AS position
      FROM merged QUALIFY position <= 200)
    SELECT CAST(position - 1 AS INTEGER) AS position, '2024-12-31 08:00' AS updated, title, url, trust FROM top"""
)
def snapshot_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 items as one JSON envelope, read back from that text."""
    from feedcore.schema import ITEM

    envelope = store.snapshot_envelope(merged(spark, folder), TRIAL, "2024-12-31 08:00", 200)
    parsed = F.from_json("snapshot", f"updated string, items array<{ITEM.simpleString()}>")
    return (
        envelope.select(parsed.alias("s"))
        .select(F.col("s.updated").alias("updated"), F.posexplode("s.items").alias("position", "i"))
        .select("position", "updated", "i.title", "i.url", "i.trust")
    )
