"""Row shapes shared by every job, and the explicit ordering columns.

The feed is an ordered set: the first copy of a title survives, and ties in
the ranking keep the order in which rows came in.  A DataFrame has no order of
its own, so each item carries the columns of ``INTAKE_COLUMNS`` and each
operator that cares about order sorts by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One captured response.  All attempts at one request share ``request_id``.
RAW = T.StructType(
    [
        T.StructField("payload_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("attempt_rank", T.IntegerType()),
        T.StructField("status_ok", T.BooleanType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

LINK = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("url", T.StringType())]
)

#: The published item.  ``date`` stays text because a feed may carry a malformed one.
ITEM = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("trust", T.IntegerType()),
        T.StructField("official", T.ArrayType(LINK)),
        T.StructField("summary_lines", T.ArrayType(T.StringType())),
        T.StructField("impact", T.StringType()),
    ]
)

#: Where a row came in: newest run first, then source, then query group, then
#: payload, then position inside the payload.  Kept in the store, so a stored
#: set remembers its order without a dense global row number.
INTAKE = T.StructType(
    [
        T.StructField("run_seq", T.LongType()),
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("group_rank", T.IntegerType()),
        T.StructField("payload_id", T.StringType()),
        T.StructField("feed_pos", T.LongType()),
    ]
)

STORED = T.StructType(ITEM.fields + INTAKE.fields)

ITEM_COLUMNS = ITEM.fieldNames()
INTAKE_COLUMNS = INTAKE.fieldNames()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns; absent ones become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty; one made from a list starts Python workers."""
    return conform(spark.range(1).where("false").drop("id"), schema)


def intake_order() -> list[Column]:
    """Order in which rows entered: newest run first, then feed order."""
    return [
        F.col("run_seq").desc_nulls_last(),
        F.col("source_rank").asc_nulls_last(),
        F.col("group_rank").asc_nulls_last(),
        F.col("payload_id").asc_nulls_last(),
        F.col("feed_pos").asc_nulls_last(),
    ]
