"""Re-checking the stored set, merging a run into it, publishing the result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.functions.dates import day
from feedcore.functions.matching import (
    is_official,
    is_official_on_reload,
    match_strict,
    should_exclude,
)
from feedcore.functions.summary import impact_pick, summary_lines
from feedcore.operators.browse import count_by_category
from feedcore.operators.first import FEED_KEY, feed_dedup, first_per_key, with_feed_key
from feedcore.operators.lookup import broadcast_if_small, migrate_allowed
from feedcore.operators.profile import failure_list, intake_report
from feedcore.plans.ingest import fill_missing, ingest, request_outcomes
from feedcore.rules import RuleBook
from feedcore.schema import STORED, conform, intake_order
from feedcore.sources.readers import WIRED, Source
from feedcore.sources import folders
from feedcore.sources.store import (
    laid_out,
    latest_run,
    read_items_json,
    read_store,
    snapshot_envelope,
    write_ranked,
    write_store,
)


def revalidate(stored: DataFrame, rules: RuleBook) -> DataFrame:
    """Stored rows that still pass today's rules, with gaps filled.

    Old category names are renamed and unknown ones dropped.  Official rows stay;
    others must not be noise or advertising and must match strictly, even if
    they came in by the looser test.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    official = is_official_on_reload(F.col("source"), F.col("source_type"), rules)
    still_fits = ~should_exclude(title, rules) & match_strict(title, F.col("category"), rules)
    kept = migrate_allowed(stored, rules).where(official | still_fits)
    return fill_missing(kept, rules)


def cutoff(as_of: dt.date | str, keep_days: int) -> Column:
    return F.date_format(F.date_sub(day(as_of), keep_days), "yyyy-MM-dd")


def retained(rules: RuleBook, as_of: dt.date | str) -> Column:
    """Official rows always; others if dated on or after the cut-off, as text."""
    fresh = F.coalesce(F.col("date"), F.lit("")) >= cutoff(as_of, rules.keep_days)
    return is_official(F.col("source_type"), rules) | fresh


def summarize(items: DataFrame, rules: RuleBook) -> DataFrame:
    """Summary lines and impact sentence for every row, old ones too."""
    official = is_official(F.col("source_type"), rules)
    return items.withColumns(
        {
            "summary_lines": summary_lines(
                F.col("title"), F.col("category"), F.col("source"), official, rules
            ),
            "impact": impact_pick(F.col("title"), F.col("category"), rules),
        }
    )


def _of_run(new: DataFrame, run: int) -> DataFrame:
    return conform(new, STORED).withColumn("run_seq", F.lit(run).cast("long"))


def _before_run(stored: DataFrame, run: int) -> DataFrame:
    before = F.least(F.coalesce(F.col("run_seq"), F.lit(0)), F.lit(run - 1))
    return conform(stored, STORED).withColumn("run_seq", before.cast("long"))


def union_generations(new: DataFrame, stored: DataFrame, run: int) -> DataFrame:
    """New rows ahead of stored ones: the run number orders them."""
    return _of_run(new, run).unionByName(_before_run(stored, run))


def merge(
    new: DataFrame, stored: DataFrame, rules: RuleBook, as_of: dt.date | str, run: int
) -> DataFrame:
    """One clean set out of a run and any stored rows: one shuffle, on the dedup key."""
    united = union_generations(new, stored, run)
    return summarize(feed_dedup(united, rules).where(retained(rules, as_of)), rules)


def merge_parts(
    new: DataFrame, stored: DataFrame, rules: RuleBook, as_of: dt.date | str, run: int
) -> tuple[DataFrame, DataFrame]:
    """``merge`` for a stored set that ``merge`` wrote: new rows and kept stored rows.

    Such a set has no duplicates of its own.  So only the run is de-duplicated,
    and a stored row goes if the run has its key.  The run's keys are broadcast
    if they are few, and then the stored set is not shuffled at all.  Expired
    stored rows shadow nothing and are dropped while reading.
    """
    fresh = first_per_key(
        with_feed_key(_of_run(new, run), rules), FEED_KEY, intake_order()
    )
    old = with_feed_key(_before_run(stored.where(retained(rules, as_of)), run), rules)
    taken = broadcast_if_small(fresh.select(*FEED_KEY))
    kept = old.join(taken, FEED_KEY, "left_anti").drop(*FEED_KEY)
    fresh = fresh.drop(*FEED_KEY).where(retained(rules, as_of))
    return summarize(fresh, rules), summarize(kept, rules)


def merge_touched(
    spark: SparkSession, new: DataFrame, store: str, rules: RuleBook, as_of: dt.date | str, run: int
) -> None:
    """``merge_parts`` into a store of which only touched folders are rewritten.

    A folder is touched if the run has a row for it, or if one of its rows gives way to
    the run's, or expires.  Folders whose every row has expired are let go unread.  Rows that
    passed the same rules before pass again, so only new rules touch all folders.
    To the driver: one row a folder.
    """
    mark = folders.rules_mark(rules)
    held = folders.unexpired(folders.in_force(spark, store)[1], _keep_from(as_of, rules))
    # The run is de-duplicated once; a crashed attempt's rows are replaced.
    path = f"{store}/_fresh/run={run}"
    first = first_per_key(with_feed_key(_of_run(new, run), rules), FEED_KEY, intake_order())
    laid_out(first, rules, FEED_KEY).write.mode("overwrite").parquet(path)
    fresh = spark.read.parquet(path)
    taken = broadcast_if_small(fresh.select(*FEED_KEY))

    def with_key(rows: list[folders.Folder]) -> DataFrame:
        return with_feed_key(_before_run(folders.read_folders(spark, store, rows), run), rules)

    changed = fresh.where(retained(rules, as_of)).select(*folders.LAYOUT).distinct()
    known = [f for f in held if f.rules == mark]
    if known:
        old = with_key(known)
        going = laid_out(old.join(taken, FEED_KEY, "left_semi"), rules).unionByName(laid_out(old.where(~retained(rules, as_of)), rules))
        changed = changed.unionByName(going.select(*folders.LAYOUT)).distinct()
    touched = {(r.is_official, r.month) for r in changed.collect()} | {f.key for f in held if f.rules != mark}
    moved = [f for f in held if f.key in touched]
    stored = revalidate(folders.read_folders(spark, store, moved), rules)
    old = with_feed_key(_before_run(stored.where(retained(rules, as_of)), run), rules)
    kept = old.join(taken, FEED_KEY, "left_anti").drop(*FEED_KEY)
    both = fresh.drop(*FEED_KEY, *folders.LAYOUT).where(retained(rules, as_of)).unionByName(kept)
    rows = laid_out(summarize(both, rules), rules)
    folders.put_in_force(spark, store, run, rows, [f for f in held if f.key not in touched], mark)
    folders.remove_unused(spark, store)


@dataclass(frozen=True)
class Published:
    """What a run wrote, and small reports on it."""

    store: str
    items: DataFrame
    by_category: DataFrame
    report: DataFrame
    failures: DataFrame


def run_job(
    spark: SparkSession,
    raw: DataFrame,
    store: str,
    rules: RuleBook,
    as_of: dt.date | str,
    run: int,
    sources: Sequence[Source] = WIRED,
    ranked: str | None = None,
    first_load: str | None = None,
) -> Published:
    """Ingest, re-check, merge and store one run; reports read what was written.

    The run's own items are written below the store first: payloads are parsed
    once, and a lost executor costs a re-read, not a re-parse.  Repeating a
    finished run is harmless: its result is returned as it is.  A store without any run
    begins with the JSON item list at ``first_load``, if there is one.
    """
    if first_load and latest_run(spark, store) is None:
        write_store(read_items_json(spark, first_load)[0], store, 0, rules)
    staged = f"{store}/_new/run={run}"
    if (latest_run(spark, store) or 0) < run:
        ingest(raw, rules, as_of, run, sources).write.mode("overwrite").parquet(staged)
        new = spark.read.schema(STORED).parquet(staged)
        merge_touched(spark, new, store, rules, as_of, run)
    items = read_store(spark, store)
    if ranked:
        write_ranked(items, ranked, rules)
    outcomes = request_outcomes(raw, sources)
    names = F.array(*[F.lit(s.name) for s in sources])
    came_in = spark.read.schema(STORED).parquet(staged).select(
        F.get(names, F.col("source_rank")).alias("source"), "category"
    )
    return Published(
        store=store,
        items=items,
        by_category=count_by_category(items),
        report=intake_report(outcomes, came_in),
        failures=failure_list(outcomes),
    )


def _keep_from(as_of: dt.date | str, rules: RuleBook) -> dt.date:
    return dt.date.fromisoformat(str(as_of)) - dt.timedelta(days=rules.keep_days)


def publish_envelope(items: DataFrame, path: str, rules: RuleBook, updated: str, n: int) -> None:
    """The ``{updated, items}`` envelope with the first ``n`` items, as one JSON text."""
    snapshot_envelope(items, rules, updated, n).write.mode("errorifexists").text(path)
