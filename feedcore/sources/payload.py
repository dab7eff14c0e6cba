"""From captured responses to the one payload used per request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.functions.matching import any_contains
from feedcore.operators.lookup import MAX_BROADCAST_ROWS

# The smallest plausible body, and what an XML answer contains.
MIN_BYTES = 100
XML_MARKERS = ("<item", "<rss", "<?xml", "<law", "<LawSearch", "<channel")


def looks_ok(body: Column, needs_xml: bool = True) -> Column:
    """True for a body long enough and, if asked, with an XML marker in it."""
    long_enough = F.coalesce(F.octet_length(body) >= MIN_BYTES, F.lit(False))
    return long_enough & any_contains(body, XML_MARKERS) if needs_xml else long_enough


def accepted(needs_xml: bool = True) -> Column:
    """True for an attempt that may be used.

    A successful first attempt is final whatever it holds; later attempts count
    only if their body looks right.
    """
    usable = (F.col("attempt_rank") == 0) | looks_ok(F.col("body"), needs_xml)
    return F.coalesce(F.col("status_ok"), F.lit(False)) & usable


def _winners(candidates: DataFrame) -> DataFrame:
    """Payload id of the lowest-ranked candidate per request, from ids and ranks alone."""
    return (
        candidates.groupBy("request_id")
        .agg(F.min(F.struct("attempt_rank", "payload_id")).alias("_w"))
        .select("request_id", F.col("_w.payload_id").alias("_winner"))
    )


@dataclass(frozen=True)
class Contested:
    """Requests with several successful answers: none, a short list, or too many to list."""

    requests: DataFrame
    found: int
    short: bool


def contested_requests(raw: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS) -> Contested:
    """List the requests that need a choice, from the narrow columns alone."""
    several = (
        raw.where("status_ok and request_id is not null")
        .groupBy("request_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("request_id")
    )
    found = several.limit(max_broadcast + 1).count()
    return Contested(several, found, found <= max_broadcast)


def best_attempts(
    raw: DataFrame, needs_xml: bool = True, contested: Contested | None = None
) -> DataFrame:
    """The attempt each request uses; requests without one are left out.

    Only requests with several successful answers need a choice, and capturing
    stops at the first good one, so they are few.  Their winners, one row each,
    are broadcast to a scan of the candidates: bodies are neither sorted nor
    grouped and never cross the network.  If the contested requests are too many
    for that, winners are joined back by request and payload id, so one key is one
    request.  An attempt without a request id is a request of its own.
    """
    contested = contested or contested_requests(raw)
    candidates = raw.where(accepted(needs_xml))
    if contested.found == 0:
        return candidates
    if not contested.short:
        named = candidates.where("request_id is not null")
        chosen = _winners(named).select("request_id", F.col("_winner").alias("payload_id"))
        alone = candidates.where("request_id is null")
        return named.join(chosen, ["request_id", "payload_id"], "left_semi").unionByName(alone)
    rivals = candidates.join(F.broadcast(contested.requests), "request_id", "left_semi")
    return (
        candidates.join(F.broadcast(_winners(rivals)), "request_id", "left")
        .where(F.col("_winner").isNull() | (F.col("_winner") == F.col("payload_id")))
        .drop("_winner")
    )
