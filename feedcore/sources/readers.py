"""Readers: payloads of one kind of source in, items out.

A reader is a function ``(payloads, rules, as_of) -> DataFrame`` that returns the
columns of ``READER_COLUMNS``.  Register another ``Source`` to add one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.functions.dates import (
    EFFECTIVE_WORD,
    board_date,
    choose_date,
    compact_date,
    day_text,
    ministry_date,
    news_api_date,
    press_release_date,
    search_feed_date,
)
from feedcore.functions.matching import (
    any_contains,
    classify_ordered,
    is_ad,
    match_loose,
    match_strict,
    should_exclude,
)
from feedcore.functions.text import (
    clean_text,
    let,
    markup_text,
    outlet_of_title,
    settle,
    strip,
    strip_tags,
    title_without_outlet,
)
from feedcore.functions.urls import join_url, law_url, outlet_from_url, script_or, site_url, with_trust
from feedcore.operators.first import exact_dedup
from feedcore.rules import KeywordRule, RuleBook
from feedcore.sources import scan

Day = dt.date | str

READER_COLUMNS = [
    "source", "source_type", "category", "title", "url", "date", "trust",
    "group_rank", "payload_id", "feed_pos",
]

# Names, addresses and patterns of the shipped sources.
LAW_SOURCE = "법제처"
LAW_BASE = "https://www.law.go.kr"
LAW_ARTICLE_PATH = "/법령/"
REGULATOR_SOURCE = "금융위원회"
SEARCH_OUTLET = "구글뉴스"
PORTAL_OUTLET = "네이버뉴스"
PORTAL_DOMAIN = "naver.com"
MINISTRY_SOURCE = "기획재정부"
TAX_BOARD_SOURCE = "국세청"
TAX_BOARD_BASE = "https://www.nts.go.kr"
TAX_BOARD_VIEW = "/nts/na/ntt/selectNttInfo.do?mi=2201&bbsId=1030&nttSn="
TAX_BOARD_ID = r"nttSn=(\d+)|['\"](\d+)['\"]"
STANDARDS_SOURCE = "회계기준원"
STANDARDS_CATEGORY = "회계기준"
STANDARDS_BASE = "https://www.kasb.or.kr"
STANDARDS_LIST = "/fe/bbs/NR_list.do?bbsCd="
STANDARDS_VIEW = "/fe/bbs/NR_view.do?bbsCd="
STANDARDS_VIEW_ID = "&bbsSeq="
STANDARDS_ID = r"['\"(](\d{4,})['\")]"
BRIEFING_SOURCE = "정책브리핑"
SUPERVISOR_SOURCE = "금융감독원"
SUPERVISOR_BASE = "https://www.fss.or.kr"
SUPERVISOR_LIST = "https://www.fss.or.kr/fss/bbs/B0000188/list.do?menuNo=200218"
TAX_CATEGORY = "세법"
MIN_ANCHOR_TITLE = 6
MIN_BOARD_TITLE = 4


def _items(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the reader columns; those not given keep their name or are null."""
    given = dict(columns)
    given.setdefault("source_type", F.lit(None).cast("string"))
    given.setdefault("trust", F.lit(None).cast("int"))
    given.setdefault("group_rank", F.lit(0))
    return df.select(*[given.get(c, F.col(c)).alias(c) for c in READER_COLUMNS])


def has_title_and_link(df: DataFrame) -> DataFrame:
    return df.where((F.col("title") != "") & (F.col("url") != ""))


def cleaned_rss(payloads: DataFrame) -> DataFrame:
    """Feed entries with cleaned title and link; entries without either are dropped."""
    rows = scan.rss_entries(payloads)
    both = F.transform(F.array("raw_title", "raw_link"), clean_text)
    cleaned = rows.withColumn("_clean", both).withColumns(
        {"title": F.get("_clean", 0), "url": F.get("_clean", 1)}
    )
    return has_title_and_link(settle(cleaned, "title", "url"))


def cleaned_news(payloads: DataFrame) -> DataFrame:
    """JSON news entries with their title freed of markup, as ``cleaned_rss``."""
    rows = scan.news_entries(payloads).withColumns(
        {"title": strip_tags(F.col("raw_title")), "url": F.col("raw_link")}
    )
    return has_title_and_link(settle(rows, "title", "url"))


def law_label(name: Column, kind: Column, effective: Column) -> Column:
    """``name (kind) · date <effective word>``; empty parts are left out."""
    return F.concat(
        name,
        F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(F.lit("")),
        F.when(
            effective != "", F.concat(F.lit(" · "), effective, F.lit(f" {EFFECTIVE_WORD}"))
        ).otherwise(F.lit("")),
    )


def law_name_matches(requested: Column, returned: Column) -> Column:
    """True if the returned name contains the requested one, spaces aside."""

    def squeeze(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit(""))

    return F.contains(squeeze(returned), squeeze(requested))


def law_group_rank(category: Column, law: Column, rules: RuleBook) -> Column:
    """Place of a requested law in the list of groups; null if it is not listed."""
    pairs = [(c, one) for c, laws in rules.law_groups.items() for one in laws]
    result = F.lit(None).cast("int")
    for i, (c, one) in reversed(list(enumerate(pairs))):
        result = F.when((category == c) & (law == one), F.lit(i)).otherwise(result)
    return result


def law_registry(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    """Laws of the requested names; the first category keeps a law found twice."""
    asked = payloads.withColumn(
        "group_rank", law_group_rank(F.col("category"), F.col("query"), rules)
    ).where(F.col("group_rank").isNotNull())
    found = settle(scan.law_entries(asked), "law_name").where(
        (F.col("law_name") != "") & law_name_matches(F.col("query"), F.col("law_name"))
    )
    dated = found.withColumns(
        {
            "published": compact_date(F.col("raw_published")),
            "effective": compact_date(F.col("raw_effective")),
        }
    )
    order = [F.col("group_rank"), F.col("payload_id"), F.col("feed_pos")]
    unique = exact_dedup(dated, ("law_name", "published", "effective"), order)
    return _items(
        unique,
        source=F.lit(LAW_SOURCE),
        source_type=F.lit(rules.official_type),
        title=law_label(F.col("law_name"), F.col("kind"), F.col("effective")),
        url=law_url(F.col("raw_link"), F.col("law_name"), LAW_BASE, LAW_ARTICLE_PATH),
        date=choose_date(F.col("published"), F.col("effective"), as_of),
        trust=F.lit(rules.official_trust),
        group_rank=F.col("group_rank"),
    )


def _classified_rss(
    payloads: DataFrame, exclude: tuple[str, ...], ordered: tuple[KeywordRule, ...]
) -> DataFrame:
    rows = cleaned_rss(payloads).where(~any_contains(F.col("title"), exclude))
    return rows.withColumn("category", classify_ordered(F.col("title"), ordered)).where(
        F.col("category").isNotNull()
    )


def regulator_rss(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    rows = _classified_rss(payloads, rules.regulator_exclude, rules.regulator_rules)
    return _items(
        rows,
        source=F.lit(REGULATOR_SOURCE),
        source_type=F.lit(rules.official_type),
        date=press_release_date(F.col("raw_date"), as_of),
        trust=F.lit(rules.official_trust),
    )


@dataclass(frozen=True)
class NewsPolicy:
    """How news rows are accepted and named.  The defaults are the current rules."""

    match: str = "strict"  # none, loose or strict
    noise: bool = True
    check_outlet: bool = True
    trusted_outlet: bool = True
    scored: bool = True
    source_type: str | None = None


SEARCH_POLICY = NewsPolicy()
PORTAL_POLICY = NewsPolicy(match="loose", check_outlet=False)
SEARCH_POLICY_V1 = NewsPolicy("none", False, True, False, False, SEARCH_OUTLET)
PORTAL_POLICY_V1 = NewsPolicy("none", False, True, False, False, PORTAL_OUTLET)


def _news_test(rules: RuleBook, policy: NewsPolicy) -> Callable[[Column], Column]:
    """What a news entry must pass, given its title, link and outlet."""

    def accept(entry: Column) -> Column:
        title, category = entry["title"], F.col("category")
        outlet = entry["outlet"] if policy.check_outlet else None
        refuse = should_exclude if policy.noise else is_ad
        test = entry["complete"] & ~refuse(title, rules, outlet)
        if policy.match == "strict":
            test = test & match_strict(title, category, rules)
        elif policy.match == "loose":
            test = test & match_loose(title, category, rules)
        return test

    return accept


def _news_items(kept: DataFrame, date: Column, rules: RuleBook, policy: NewsPolicy) -> DataFrame:
    """Name and score the accepted news rows."""
    names = [rule.category for rule in rules.categories]
    ranks = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("category")).cast("int")
    scored = with_trust(kept, rules, "url", "trust", "trusted_name")
    outlet = F.col("outlet")
    return _items(
        scored,
        source=F.coalesce(F.col("trusted_name"), outlet) if policy.trusted_outlet else outlet,
        source_type=F.lit(policy.source_type or rules.news_type),
        date=date,
        trust=F.col("trust") if policy.scored else F.lit(None).cast("int"),
        group_rank=ranks,
    )


def _entry(pos: Column, **fields: Column) -> Column:
    return F.struct(
        pos.cast("long").alias("feed_pos"), *[c.alias(name) for name, c in fields.items()]
    )


def search_news(
    payloads: DataFrame, rules: RuleBook, as_of: Day, policy: NewsPolicy = SEARCH_POLICY
) -> DataFrame:
    """News search feeds: ``title - outlet`` entries, one category per request."""

    def derive(entry: Column, pos: Column) -> Column:
        def parts(clean: Column) -> Column:
            full, link = F.get(clean, 0), F.get(clean, 1)
            return _entry(
                pos,
                title=title_without_outlet(full),
                outlet=outlet_of_title(full, SEARCH_OUTLET),
                url=link,
                complete=(full != "") & (link != ""),
                raw_date=entry["pubDate"],
            )

        return let(F.transform(F.array(entry["title"], entry["link"]), clean_text), parts)

    kept = scan.first_accepted(
        payloads,
        scan.parse_rss(F.col("body")),
        scan.rss_array,
        derive,
        _news_test(rules, policy),
        rules.search_cap,
    )
    return _news_items(kept, search_feed_date(F.col("raw_date"), as_of), rules, policy)


def portal_news(
    payloads: DataFrame, rules: RuleBook, as_of: Day, policy: NewsPolicy = PORTAL_POLICY
) -> DataFrame:
    """JSON news answers: marked-up titles, one category per request."""

    def derive(entry: Column, pos: Column) -> Column:
        def parts(title: Column) -> Column:
            link = scan.news_link(entry)
            known = policy.trusted_outlet
            return _entry(
                pos,
                title=title,
                outlet=F.lit(PORTAL_OUTLET) if known else outlet_from_url(link, PORTAL_DOMAIN, PORTAL_OUTLET),
                url=link,
                complete=(title != "") & (link != ""),
                raw_date=entry["pubDate"],
            )

        return let(strip_tags(entry["title"]), parts)

    kept = scan.first_accepted(
        payloads,
        scan.parse_news(F.col("body")),
        scan.news_array,
        derive,
        _news_test(rules, policy),
        rules.portal_cap,
    )
    return _news_items(kept, news_api_date(F.col("raw_date"), as_of), rules, policy)


def ministry_rss(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    """Press releases with a tax word in the title; empty links are kept."""
    rows = scan.rss_entries(payloads).withColumns(
        {"title": strip(F.col("raw_title")), "url": strip(F.col("raw_link"))}
    )
    return _items(
        settle(rows, "title").where(any_contains(F.col("title"), rules.ministry_keywords)),
        source=F.lit(MINISTRY_SOURCE),
        category=F.lit(TAX_CATEGORY),
        date=ministry_date(F.col("raw_date"), as_of),
    )


def tax_board(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    rows = scan.row_link_entries(payloads)
    href = F.col("raw_link")
    return _items(
        rows,
        source=F.lit(TAX_BOARD_SOURCE),
        category=F.lit(TAX_CATEGORY),
        title=F.col("raw_title"),
        url=script_or(
            href, TAX_BOARD_ID, TAX_BOARD_BASE + TAX_BOARD_VIEW, join_url(TAX_BOARD_BASE, href), 2
        ),
        date=board_date(F.col("row_text"), as_of),
    )


def standards_board(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    """Board rows; the request's ``query`` is the board's code."""
    rows = settle(scan.row_link_entries(payloads), "raw_title").where(
        F.char_length("raw_title") >= MIN_BOARD_TITLE
    )
    href, board = F.col("raw_link"), F.col("query")
    listing = F.concat(F.lit(STANDARDS_BASE + STANDARDS_LIST), board)
    view = F.concat(F.lit(STANDARDS_BASE + STANDARDS_VIEW), board, F.lit(STANDARDS_VIEW_ID))
    return _items(
        rows,
        source=F.lit(STANDARDS_SOURCE),
        category=F.lit(STANDARDS_CATEGORY),
        title=F.col("raw_title"),
        url=script_or(href, STANDARDS_ID, view, site_url(href, STANDARDS_BASE, listing)),
        date=board_date(F.col("row_text"), as_of),
    )


def briefing_rss(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    rows = _classified_rss(payloads, rules.briefing_exclude, rules.briefing_rules)
    return _items(
        rows, source=F.lit(BRIEFING_SOURCE), date=press_release_date(F.col("raw_date"), as_of)
    )


def mixed_rss(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    rows = _classified_rss(payloads, rules.mixed_exclude, rules.mixed_rules)
    return _items(
        rows, source=F.lit(REGULATOR_SOURCE), date=press_release_date(F.col("raw_date"), as_of)
    )


def supervisor_anchors(payloads: DataFrame, rules: RuleBook, as_of: Day) -> DataFrame:
    """Anchors of a listing page with a fitting title; the first ones per page."""

    def derive(anchor: Column, pos: Column) -> Column:
        return _entry(pos, title=markup_text(anchor), raw_link=scan.anchor_link(anchor))

    def accept(entry: Column) -> Column:
        title = entry["title"]
        fitting = any_contains(title, [k for rule in rules.mixed_rules for k in rule.keywords])
        return (
            (F.char_length(title) >= MIN_ANCHOR_TITLE)
            & ~any_contains(title, rules.mixed_exclude)
            & fitting
        )

    kept = scan.first_accepted(
        payloads, scan.anchor_array(F.col("body")), lambda p: p, derive, accept, rules.anchor_cap
    )
    return _items(
        kept,
        source=F.lit(SUPERVISOR_SOURCE),
        category=classify_ordered(F.col("title"), rules.mixed_rules),
        url=site_url(F.col("raw_link"), SUPERVISOR_BASE, SUPERVISOR_LIST),
        date=day_text(as_of),
    )


@dataclass(frozen=True)
class Source:
    """A registered source; ``name`` is what the payload's ``source`` column holds."""

    name: str
    read: Callable[..., DataFrame]
    content: str = "rss"  # rss, law, news or html: how a broken payload is told
    needs_xml: bool = True
    complete: bool = True  # False: type and trust are open, categories may be old names


WIRED = (
    Source("law_registry", law_registry, "law"),
    Source("regulator_rss", regulator_rss),
    Source("search_news", search_news),
    Source("portal_news", portal_news, "news", needs_xml=False),
)

OPTIONAL = (
    Source("ministry_rss", ministry_rss, complete=False),
    Source("tax_board", tax_board, "html", needs_xml=False, complete=False),
    Source("standards_board", standards_board, "html", needs_xml=False, complete=False),
    Source("briefing_rss", briefing_rss, complete=False),
    Source("mixed_rss", mixed_rss, complete=False),
    Source("supervisor_anchors", supervisor_anchors, "html", needs_xml=False, complete=False),
)
