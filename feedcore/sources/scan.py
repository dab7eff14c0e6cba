"""Payload scans: one row per feed entry, in payload order.

``from_xml``/``from_json`` parse a payload in one call.  Broken payloads give no
entries and keep their text in ``_corrupt``, so one bad answer never stops a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.functions.text import attribute, first_non_empty, let, markup_text
from feedcore.sources.elements import INSIDE_TAG as _INSIDE_TAG
from feedcore.sources.elements import elements, opening_tags

_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

_RSS_ENTRY = "struct<title array<string>, link array<string>, pubDate array<string>>"
_RSS = (
    f"channel array<struct<item array<{_RSS_ENTRY}>>>, item array<{_RSS_ENTRY}>, _corrupt string"
)

# Element names in the law registry's answers.
LAW_NAME = ("법령명한글", "법령명")
LAW_PUBLISHED = ("공포일자",)
LAW_EFFECTIVE = ("시행일자",)
LAW_KIND = ("제개정구분명", "제개정구분")
LAW_LINK = ("법령상세링크",)
LAW_NODE = "law"

_NEWS = (
    "items array<struct<title string, originallink string, link string, pubDate string>>, "
    "_corrupt string"
)


def _entries(payloads: DataFrame, parsed: Column, entries) -> DataFrame:
    """Explode parsed entries next to the payload's own columns, body left out."""
    carried = [c for c in payloads.columns if c != "body"]
    return (
        payloads.select(*carried, parsed.alias("_p"))
        .select(*carried, F.posexplode(entries(F.col("_p"))).alias("feed_pos", "_e"))
        .withColumn("feed_pos", F.col("feed_pos").cast("long"))
    )


def first_accepted(
    payloads: DataFrame,
    parsed: Column,
    entries: Callable[[Column], Column],
    derive: Callable[[Column, Column], Column],
    accept: Callable[[Column], Column],
    n: int | None,
) -> DataFrame:
    """First ``n`` accepted (all, if ``n`` is None) entries of each payload, without a shuffle.

    A payload's entries sit in one row, so they are derived, tested and cut as an
    array; only what is kept becomes rows.
    """
    carried = [c for c in payloads.columns if c != "body"]
    made = payloads.select(*carried, parsed.alias("_p")).select(
        *carried, F.transform(entries(F.col("_p")), derive).alias("_made")
    )
    kept = F.filter("_made", accept)
    if n is not None:
        kept = F.slice(kept, 1, n)
    return made.select(*carried, F.inline(kept))


def _drop_entry(df: DataFrame) -> DataFrame:
    return df.drop("_e")


def _empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _any_depth(body: Column, parsed: Column, node: str, schema: str, fixed: Column) -> Column:
    """``node`` elements at any depth, where a sound payload has more of them than ``fixed`` paths found; else null.

    Each element's content is parsed apart from the elements around it, so a field is always its own child.
    """
    single = F.transform(elements(body, node), lambda e: F.concat(F.lit(f"<{node}>"), e["inner"], F.lit(f"</{node}>")))
    whole = F.from_xml(F.concat(F.lit("<r>"), F.array_join(single, ""), F.lit("</r>")), schema, _PERMISSIVE)
    more = parsed["_corrupt"].isNull() & (opening_tags(body, node) > F.size(fixed))
    return F.when(more, whole[node])


def _first_of_each(entries: Column) -> Column:
    """Of an element that is given twice the first counts."""
    return F.transform(
        entries, lambda e: F.struct(*[F.get(e[n], F.lit(0)).alias(n) for n in ("title", "link", "pubDate")])
    )


def _fixed_items(parsed: Column) -> Column:
    """``item`` elements below all channels, then those below the root (RSS 1.0)."""
    none = F.array().cast(f"array<{_RSS_ENTRY}>")
    below = F.flatten(F.transform(parsed["channel"], lambda c: F.coalesce(c["item"], none)))
    return F.concat(F.coalesce(below, none), F.coalesce(parsed["item"], none))


def parse_rss(body: Column) -> Column:
    """``items`` in document order, at any depth, and ``_corrupt``.

    One parse of fixed paths is enough for nearly all feeds; the others are cut by balanced tags.
    """

    def both(parsed: Column) -> Column:
        fixed = _fixed_items(parsed)
        deep = _any_depth(body, parsed, "item", f"item array<{_RSS_ENTRY}>, _corrupt string", fixed)
        return F.struct(F.coalesce(deep, fixed).alias("items"), parsed["_corrupt"].alias("_corrupt"))

    return let(F.from_xml(body, _RSS, _PERMISSIVE), both)


def rss_array(parsed: Column) -> Column:
    return _first_of_each(parsed["items"])


def rss_entries(payloads: DataFrame) -> DataFrame:
    """Feed entries with raw title, link and date; absent ones are empty."""
    rows = _entries(payloads, parse_rss(F.col("body")), rss_array)
    return _drop_entry(
        rows.withColumns(
            {
                "raw_title": _empty_if_null(F.col("_e.title")),
                "raw_link": _empty_if_null(F.col("_e.link")),
                "raw_date": _empty_if_null(F.col("_e.pubDate")),
            }
        )
    )


_LAW_FIELDS = [*LAW_NAME, *LAW_PUBLISHED, *LAW_EFFECTIVE, *LAW_KIND, *LAW_LINK]
_LAW_NODES = "array<struct<" + ", ".join(f"`{n}` string" for n in _LAW_FIELDS) + ">>"
_LAWS = f"`{LAW_NODE}` {_LAW_NODES}, _corrupt string"
# An answer's head up to its root element, and an element that holds nothing but leaves.
_ROOT = r"(?s)^(?:[^<]|<[?!][^>]*>)*+<[^<>]*>"
_LEAF = r"<([^\s<>/!?]++)[^<>]*+>(?:[^<]|<!\[CDATA\[.*?\]\]>)*+</\{}\s*>|<[^\s<>/!?]++[^<>]*/>"
_FLAT = r"(?s)<([^\s<>/!?]++)(?:\s[^<>]*)?+(?<!/)>((?:\s*+(?:" + _LEAF.format(3) + r"))++\s*+)</\1\s*>"


def parse_laws(body: Column) -> Column:
    return F.from_xml(body, _LAWS, _PERMISSIVE)


def _other_laws(body: Column) -> Column:
    """Elements of any tag and depth that hold nothing but leaves, a law's name among them."""
    flat = F.regexp_extract_all(F.regexp_replace(body, _ROOT, ""), F.lit(_FLAT), F.lit(2))
    laws = F.transform(flat, lambda x: F.concat(F.lit(f"<{LAW_NODE}>"), x, F.lit(f"</{LAW_NODE}>")))
    parsed = parse_laws(F.concat(F.lit("<r>"), F.array_join(laws, ""), F.lit("</r>")))
    return F.filter(
        parsed[LAW_NODE],
        lambda n: F.coalesce(*[F.nullif(n[t], F.lit("")) for t in LAW_NAME]).isNotNull(),
    )


def law_entries(payloads: DataFrame) -> DataFrame:
    """Law elements at any depth; where an answer has none, other elements that carry a name."""
    body = F.col("body")

    def laws(parsed: Column) -> Column:
        fixed = F.coalesce(parsed[LAW_NODE], F.array().cast(_LAW_NODES))
        deep = _any_depth(body, parsed, LAW_NODE, _LAWS, fixed)
        sound = F.coalesce(deep, parsed[LAW_NODE], _other_laws(body))
        return F.when(parsed["_corrupt"].isNull(), sound).otherwise(parsed[LAW_NODE])

    found = let(parse_laws(body), laws)

    def first(tags: tuple[str, ...]) -> Column:
        return first_non_empty(*[F.col("_e")[t] for t in tags])

    rows = _entries(payloads, F.struct(found.alias("laws")), lambda p: p["laws"])
    return _drop_entry(
        rows.withColumns(
            {
                "law_name": first(LAW_NAME),
                "raw_published": first(LAW_PUBLISHED),
                "raw_effective": first(LAW_EFFECTIVE),
                "kind": first(LAW_KIND),
                "raw_link": first(LAW_LINK),
            }
        )
    )


def parse_news(body: Column) -> Column:
    return F.from_json(body, _NEWS, _PERMISSIVE)


def news_array(parsed: Column) -> Column:
    return parsed["items"]


def news_link(entry: Column) -> Column:
    """The original link, else the portal's own."""
    return F.coalesce(F.nullif(entry["originallink"], F.lit("")), entry["link"], F.lit(""))


def news_entries(payloads: DataFrame) -> DataFrame:
    """Entries of a JSON news answer with raw title, link and date."""
    rows = _entries(payloads, parse_news(F.col("body")), news_array)
    return _drop_entry(
        rows.withColumns(
            {
                "raw_title": _empty_if_null(F.col("_e.title")),
                "raw_link": news_link(F.col("_e")),
                "raw_date": _empty_if_null(F.col("_e.pubDate")),
            }
        )
    )


_COMMENT_OR_CODE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
# An anchor ends where it is closed, where the next one starts, or with the page.
_ANCHOR = rf"(?is)<a(?=[\s>/]){_INSIDE_TAG}>.*?(?:</a\s*>|(?=<a[\s>/])|\z)"
_OPENING = rf"(?is)^<a{_INSIDE_TAG}>"


def _visible(html: Column) -> Column:
    return F.regexp_replace(_empty_if_null(html), _COMMENT_OR_CODE, "")


def anchor_link(anchor: Column) -> Column:
    return attribute(F.regexp_extract(anchor, _OPENING, 0), "href")


def _anchor_fields(anchor: Column) -> dict[str, Column]:
    return {"raw_title": markup_text(anchor), "raw_link": anchor_link(anchor)}


def anchor_array(body: Column) -> Column:
    """Every anchor of an HTML page, in document order."""
    return F.regexp_extract_all(_visible(body), F.lit(_ANCHOR), F.lit(0))


def anchor_entries(payloads: DataFrame) -> DataFrame:
    """Every anchor of an HTML page with its text and link."""
    rows = _entries(payloads, anchor_array(F.col("body")), lambda anchors: anchors)
    return _drop_entry(rows.withColumns(_anchor_fields(F.col("_e"))))


#: Rows of a listing: (element of the table or list, element of one row).
BOARD_ROWS = ("tbody", "tr")
LIST_ROWS = ("ul", "li")


def row_link_entries(payloads: DataFrame, rows: tuple[str, str] = BOARD_ROWS) -> DataFrame:
    """Listing rows with an anchor: the first anchor's text and link, the row's text.

    ``rows`` names the enclosing element and the row element.  Rows are found at any depth;
    one that holds a list or table of its own has that one's text and anchors as well.
    """
    outer, inner = rows
    found = F.transform(elements(_visible(F.col("body")), inner, outer), lambda e: F.concat(e["tag"], e["inner"]))
    linked = F.filter(found, lambda r: r.rlike(r"(?i)<a[\s>/]"))
    exploded = _entries(payloads, F.struct(linked.alias("r")), lambda p: p["r"])
    anchor = F.regexp_extract(F.col("_e"), _ANCHOR, 0)
    return _drop_entry(
        exploded.withColumns(
            {**_anchor_fields(anchor), "row_text": markup_text(F.col("_e"), " ")}
        )
    )
