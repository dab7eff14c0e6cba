"""The stored set and the published snapshot.

``write_store`` writes a whole set as a new folder ``run=<n>`` and never the one being
read; a reader takes the newest finished one (the one with Spark's ``_SUCCESS``
mark), so a job that dies half-way leaves the previous set in force.  Jobs rewrite
only the folders they touch (``folders``); both are read here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedcore.functions.matching import is_official
from feedcore.operators.rank import feed_order, rank_feed, top
from feedcore.rules import RuleBook
from feedcore.schema import INTAKE_COLUMNS, ITEM, ITEM_COLUMNS, STORED, conform
from feedcore.sources.json_array import SPLIT, array_records
from feedcore.sources.folders import LAYOUT, in_force, names_below, read_folders, unexpired


def exists(spark: SparkSession, path: str) -> bool:
    return bool(names_below(spark, path))


def latest_run(spark: SparkSession, path: str) -> int | None:
    """Number of the newest finished run in a store."""
    run = in_force(spark, path)[0]
    return None if run < 0 else run


def write_store(
    df: DataFrame, path: str, run: int, rules: RuleBook, kept: DataFrame | None = None
) -> str:
    """Write a full new set; files by official flag and month so expiry prunes folders.

    ``df`` is spread anew over its folders.  ``kept`` holds rows read from the
    store itself, which are already grouped that way: they are written without
    moving between executors.
    """
    target = f"{path}/run={run}"
    # What a crashed attempt left behind was never in force and is replaced.
    finished = "_SUCCESS" in names_below(df.sparkSession, target)
    # AQE splits a folder that holds a third of all rows and joins small ones.
    rows = laid_out(df, rules).hint("rebalance", *LAYOUT)
    if kept is not None:
        rows = rows.unionByName(laid_out(kept, rules))
    rows.write.mode("errorifexists" if finished else "overwrite").partitionBy(*LAYOUT).parquet(target)
    return target


def laid_out(df: DataFrame, rules: RuleBook, more: Sequence[str] = ()) -> DataFrame:
    """Stored columns, ``more`` and the columns that name a row's folder."""
    return (
        conform(df, T.StructType([*STORED.fields, *(df.schema[c] for c in more)]))
        .withColumn("is_official", is_official(F.col("source_type"), rules))
        # Expiry compares days as text, so only texts of that form have a month.
        .withColumn("month", F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring("date", 1, 7)))
    )


def read_store(
    spark: SparkSession, path: str, keep_from: dt.date | str | None = None
) -> DataFrame:
    """The newest finished set; an absent store is an empty one.

    With ``keep_from`` only folders that can hold official rows or rows of that
    month and later are read.
    """
    return read_folders(spark, path, unexpired(in_force(spark, path)[1], keep_from))


def read_items_json(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """An item list in JSON array files, and the files or records that could not be read.

    Large files are read range by range.  Absent or unreadable files give no items, nor
    does a file with an unreadable record.  The place in the file becomes the intake order.
    """
    unread = "text string"
    if not exists(spark, path):
        return spark.createDataFrame([], STORED), spark.createDataFrame([], unread)
    texts, broken = array_records(spark, path, split)
    parsed = texts.withColumn("i", F.from_json("text", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fits = F.expr("try_parse_json(text)").isNotNull() & F.col("i").isNotNull()
    wrong = parsed.where(~fits)
    rows = parsed.join(F.broadcast(wrong.select("file").distinct()), "file", "left_anti")
    # Files follow one another by name, records by place.
    rows = rows.select("i.*", F.col("file").alias("payload_id"), F.col("pos").alias("feed_pos"))
    names = spark.createDataFrame([(b,) for b in broken], unread)
    return conform(rows.withColumn("run_seq", F.lit(0).cast("long")), STORED), names.unionByName(wrong.select("text"))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A published snapshot: its items and the texts that could not be read.

    The envelope may be plain JSON or a script that assigns it to a variable.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], STORED), spark.createDataFrame([], "text string")
    bare = F.regexp_replace(F.col("value"), r"(?s)^[^{]*=\s*(?=\{)|;\s*\z", "")
    return _items_of(spark.read.text(path, wholetext=True), bare)


def _items_of(texts: DataFrame, text) -> tuple[DataFrame, DataFrame]:
    items = T.ArrayType(ITEM)
    envelope = T.StructType([T.StructField("updated", T.StringType()), T.StructField("items", items)])
    parsed = texts.select(text.alias("text"), F.from_json(text, envelope).alias("p")).select(
        "text", F.col("p.updated").alias("updated"), F.col("p.items").alias("items")
    )
    rows = (
        parsed.where(F.col("items").isNotNull())
        .select(F.posexplode("items").alias("feed_pos", "i"))
        .select("i.*", F.col("feed_pos").cast("long").alias("feed_pos"))
        .withColumn("run_seq", F.lit(0).cast("long"))
    )
    return conform(rows, STORED), parsed.where(F.col("items").isNull()).select("text")


def snapshot_updated(spark: SparkSession, path: str) -> str:
    """The ``updated`` text of a snapshot, ``-`` if there is none."""
    if not exists(spark, path):
        return "-"
    pattern = r'"updated"\s*:\s*"([^"]*)"'
    row = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", pattern, 1)).first()
    return row[0] or "-" if row else "-"


def snapshot_envelope(df: DataFrame, rules: RuleBook, updated: str, n: int) -> DataFrame:
    """One JSON text with the first ``n`` items in published order.

    ``n`` is bounded (see ``top``): the envelope is one row.  A larger feed is
    published as a table by ``write_ranked``.
    """
    ranked = top(df.select(*ITEM_COLUMNS, *INTAKE_COLUMNS), feed_order(rules), n)
    packed = ranked.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", F.struct(*ITEM_COLUMNS).alias("item")))),
            lambda x: x["item"],
        ).alias("items")
    )
    return packed.select(
        F.to_json(
            F.struct(F.lit(updated).alias("updated"), F.col("items")), {"ignoreNullFields": "false"}
        ).alias("snapshot")
    )


def write_ranked(df: DataFrame, path: str, rules: RuleBook) -> None:
    """The whole feed as JSON lines; files follow one another in published order."""
    rank_feed(df, rules).select(*ITEM_COLUMNS).write.mode("errorifexists").json(path)
