"""Continuous intake: an extension of the batch job, with the same results.

``stream_job`` runs the batch merge once per micro-batch, so the first-wins rule
has its order and the stored set is exactly the batch one.  ``stream_unique`` is
the lighter form: it emits a row when its key is first seen within the horizon.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedcore.operators.lookup import broadcast_if_small
from feedcore.plans.merge import run_job
from feedcore.rules import RuleBook
from feedcore.schema import RAW, no_rows
from feedcore.sources.payload import accepted
from feedcore.sources.readers import WIRED, Source
from feedcore.sources.store import exists

_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw payload files as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(RAW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_unique(
    rows: DataFrame, time: str, keys: Sequence[str], horizon: str = "180 days"
) -> DataFrame:
    """Rows whose key was not seen within the horizon.

    State holds one entry per live key, so it belongs on disk: see ``use_disk_state``.
    """
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB instead of executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS_DB)


def answered(raw: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Ids of the requests with an attempt that may be used."""
    tests = [(F.col("source") == s.name) & accepted(s.needs_xml) for s in sources]
    usable = reduce(lambda a, b: a | b, tests)
    return raw.where(usable & F.col("request_id").isNotNull()).select("request_id").distinct()


def answered_before(spark: SparkSession, store: str, run: int) -> DataFrame:
    """Ids of the requests answered in runs before this one; a repeated run sees the same."""
    path = f"{store}/_answered"
    if not exists(spark, path):
        return no_rows(spark, T.StructType([T.StructField("request_id", T.StringType())]))
    seen = spark.read.schema("request_id string, run long").parquet(path)
    return seen.where(F.col("run") < run).select("request_id")


def stream_job(
    raw: DataFrame,
    store: str,
    checkpoint: str,
    rules: RuleBook,
    as_of: dt.date | str,
    sources: Sequence[Source] = WIRED,
    first_run: int = 1,
) -> StreamingQuery:
    """Merge every micro-batch into the store; a repeated batch changes nothing.

    A request answered in an earlier batch is done: its later attempts are left
    out, as in a batch job that sees all attempts at once.  Capturing tries the
    attempts in order, so a lower rank does not come after a higher one.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        run, spark = first_run + batch_id, batch.sparkSession
        known = answered_before(spark, store, run)
        # Ids of this batch alone decide, so the side stays as small as the batch.
        done = batch.select("request_id").distinct().join(known, "request_id", "left_semi")
        waiting = batch.join(broadcast_if_small(done), "request_id", "left_anti")
        answered(waiting, sources).write.mode("overwrite").parquet(f"{store}/_answered/run={run}")
        run_job(spark, waiting, store, rules, as_of, run, sources)

    return (
        raw.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a Parquet folder until the input is used up."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
