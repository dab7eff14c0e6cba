"""What came in: rows and failures per source, and the tags seen in payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length of the tag sample.
TAG_ROWS = 12

NO_ANSWER = "no answer"
BROKEN = "broken payload"


def intake_report(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Per source and category: requests, failures of each kind, accepted rows.

    ``requests`` has one row per request with ``failure`` null, ``no answer`` or
    ``broken payload``; ``items`` has the accepted rows.  Both sides are counted
    before they meet, so the join is as small as the list of sources.
    """
    asked = requests.groupBy("source", "category").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("failure") == NO_ANSWER).alias("no_answer"),
        F.count_if(F.col("failure") == BROKEN).alias("broken"),
    )
    got = items.groupBy("source", "category").agg(F.count("*").alias("rows"))
    joined = asked.join(got, ["source", "category"], "full")
    counts = ["requests", "no_answer", "broken", "rows"]
    return joined.select(
        "source", "category", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    )


def failure_list(requests: DataFrame) -> DataFrame:
    """One line per failed source and kind of failure."""
    return (
        requests.where(F.col("failure").isNotNull())
        .groupBy("source", "failure")
        .agg(F.count("*").alias("n"))
    )


_HIDDEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
_TAG = r"<([A-Za-z_\x{AC00}-\x{D7A3}][^\s/>]*)"


def tags_of(body: Column) -> Column:
    """Distinct element names of a payload."""
    shown = F.regexp_replace(F.coalesce(body, F.lit("")), _HIDDEN, "")
    return F.array_distinct(F.regexp_extract_all(shown, F.lit(_TAG), F.lit(1)))


def tag_profile(payloads: DataFrame, n: int | None = TAG_ROWS) -> DataFrame:
    """Element names and in how many payloads they occur: the first ``n`` by name, or all."""
    counted = (
        payloads.select(F.explode(tags_of(F.col("body"))).alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("payloads"))
    )
    return counted if n is None else counted.orderBy("tag").limit(n)
