"""Payload scans, gates and reports.

Payloads are made from the given rows in the query: one feed per document with
one entry per line, one answer per part or order.  Then they are parsed again,
so the rows that come out can be compared with the rows that went in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.catalog.registry import any_of, query, table, text
from feedcore.catalog.views import (
    DATE_SQL,
    ITEMS,
    LINES,
    OFFICIAL,
    TRIAL,
    URL_SQL,
    classify_sql,
    clean_sql,
    exclude_sql,
    key_sql,
    match_sql,
    payload_id,
    trust_sql,
)
from feedcore.functions import dates, urls
from feedcore.operators import first, profile
from feedcore.plans.ingest import ingest, request_outcomes
from feedcore.plans.merge import run_job
from feedcore.rules import RuleBook, law_group_frame
from feedcore.operators.lookup import broadcast_if_small
from feedcore.schema import RAW, conform
from feedcore.session import shared_folder
from feedcore.sources import payload, readers, scan
from feedcore.sources.store import read_store
from feedcore.streaming import intake

AS_OF = "2025-02-01"


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _entry_url(pos: Column) -> Column:
    return F.concat(
        F.lit("https://"),
        F.when(pos % 3 == 0, F.lit("www.")).otherwise(F.lit("")),
        F.col("source"),
        F.lit(".example."),
        F.when(F.col("lang") == "en", F.lit("com"))
        .when(F.col("lang") == "fr", F.lit("org"))
        .otherwise(F.lit("net")),
        F.lit("/"),
        F.col("lang"),
        F.lit("/"),
        F.col("doc_id").cast("string"),
        F.lit("/"),
        pos.cast("string"),
    )


def _entry_day(pos: Column) -> Column:
    offset = ((F.col("doc_id") * 7 + pos) % 400).cast("int")
    return F.date_add(F.lit("2024-01-01").cast("date"), offset)


def _mail_date(d: Column) -> Column:
    return F.concat(F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 23:30:00 +0900"))


def _feed_of_lines(title) -> Column:
    """An RSS document with one item per line of ``text``."""
    entries = F.transform(
        F.split("text", "\n"),
        lambda line, pos: _tag(
            "item",
            F.concat(
                _tag("title", _escaped(title(line))),
                _tag("link", _escaped(_entry_url(pos))),
                _tag("pubDate", _mail_date(_entry_day(pos))),
            ),
        ),
    )
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss><channel><title>feed</title>'),
        F.array_join(entries, ""),
        F.lit("</channel></rss>"),
    )


def _news_of_lines() -> Column:
    """A JSON news answer with one entry per line of ``text``; odd ones lack the original link."""
    entries = F.transform(
        F.split("text", "\n"),
        lambda line, pos: F.struct(
            F.concat(F.lit("<b>"), line, F.lit("</b>")).alias("title"),
            F.when(pos % 2 == 0, _entry_url(pos)).otherwise(F.lit("")).alias("originallink"),
            F.concat(F.lit("https://portal.example/"), _entry_url(pos)).alias("link"),
            _mail_date(_entry_day(pos)).alias("pubDate"),
        ),
    )
    return F.to_json(F.struct(entries.alias("items")))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "text")


@query(
    f"""WITH {LINES} SELECT doc_id, pos, {clean_sql('title')} AS title, {URL_SQL} AS url,
          strftime({DATE_SQL}, '%Y-%m-%d') AS date
        FROM lines WHERE {clean_sql('title')} <> ''"""
)
def rss_explode(spark: SparkSession, folder: str) -> DataFrame:
    payloads = _documents(spark, folder).select("doc_id", _feed_of_lines(lambda t: t).alias("body"))
    rows = readers.cleaned_rss(payloads)
    return rows.select(
        "doc_id",
        F.col("feed_pos").alias("pos"),
        "title",
        "url",
        dates.press_release_date(F.col("raw_date"), AS_OF).alias("date"),
    )


@query(
    f"""WITH {LINES} SELECT doc_id, pos, trim(regexp_replace(title, '<[^>]+>', '', 'g')) AS title,
      CASE WHEN pos % 2 = 0 THEN {URL_SQL} ELSE 'https://portal.example/' || {URL_SQL} END AS url,
      strftime({DATE_SQL}, '%Y-%m-%d') AS date
    FROM lines WHERE {clean_sql('title')} <> ''"""
)
def news_json_explode(spark: SparkSession, folder: str) -> DataFrame:
    payloads = _documents(spark, folder).select("doc_id", _news_of_lines().alias("body"))
    return readers.cleaned_news(payloads).select(
        "doc_id",
        F.col("feed_pos").alias("pos"),
        "title",
        "url",
        dates.news_api_date(F.col("raw_date"), AS_OF).alias("date"),
    )


def _nested(level: Column, inside: Column) -> Column:
    """``inside`` below ``level`` groups."""
    return F.concat(F.repeat(F.lit("<group><title>no item</title>"), level), inside, F.repeat(F.lit("</group>"), level))


@query(
    f"""WITH {LINES} SELECT doc_id, pos, {clean_sql('title')} AS title, {URL_SQL} AS url,
          strftime({DATE_SQL}, '%Y-%m-%d') AS date
        FROM lines WHERE {clean_sql('title')} <> ''"""
)
def any_depth_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items one to five levels deep; in every second feed each odd item lies inside the even one before it."""
    inside = _documents(spark, folder).withColumn("level", (F.col("doc_id") % 5).cast("int"))

    def own(line: Column, pos: Column) -> Column:
        return F.concat(
            F.lit("<item kind='a>b'>"),
            _tag("note", F.lit("<![CDATA[</item><item>]]>")),
            _tag("title", _escaped(line)),
            _tag("link", _escaped(_entry_url(pos))),
            _tag("pubDate", _mail_date(_entry_day(pos))),
        )

    lines = F.split("text", "\n")
    last = F.size(lines) - 1
    pairs = (F.col("doc_id") % 2 == 0)
    # In pairs, an even item stays open until the odd one after it has ended.
    entries = F.transform(
        lines,
        lambda line, pos: F.concat(
            own(line, pos),
            F.when(pairs & (pos % 2 == 0) & (pos < last), F.lit("")).otherwise(F.lit("</item>")),
            F.when(pairs & (pos % 2 == 1), F.lit("</item><item-note/>")).otherwise(F.lit("")),
        ),
    )
    body = F.concat(
        F.lit("<?xml version='1.0'?><!-- <item> --><feed>"), _nested(F.col("level") + 1, F.array_join(entries, "")), F.lit("</feed>")
    )
    rows = readers.cleaned_rss(inside.select("doc_id", body.alias("body")))
    return rows.select(
        "doc_id",
        F.col("feed_pos").alias("pos"),
        "title",
        "url",
        dates.press_release_date(F.col("raw_date"), AS_OF).alias("date"),
    )


def _law_node(node: str, first_name: bool, name: Column, published: Column, kind: Column, link: Column) -> Column:
    """A law element; without ``first_name`` its first-choice tags are blank."""
    if first_name:
        named = F.concat(_tag("법령명한글", name), _tag("제개정구분명", kind))
    else:
        named = F.concat(_tag("법령명한글", F.lit(" ")), _tag("법령명", name), _tag("제개정구분", kind))
    return _tag(
        node,
        F.concat(named, _tag("공포일자", published), _tag("시행일자", F.lit("2027.01.01")), _tag("법령상세링크", link)),
    )


def _law_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per part: its own name, and its brand as a second law for large parts.

    Each fifth has no law element: its law is in another one, of every tenth a level deeper.
    """
    name = _escaped(F.col("p_name"))
    published = F.date_format(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyyMMdd"
    )
    link = F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"))
    plain = _law_node("law", True, name, published, F.col("p_type"), link)
    blank = _law_node("law", False, name, published, F.col("p_type"), link)
    second = _law_node("law", True, F.col("p_brand"), published, F.lit(""), F.lit(""))
    other = _law_node("record", True, name, published, F.col("p_type"), link)
    node = F.when(F.col("p_partkey") % 2 == 0, plain).otherwise(blank)
    deeper = F.when(F.col("p_partkey") % 10 == 0, _tag("list", other)).otherwise(other)
    node = F.when(F.col("p_partkey") % 5 == 0, deeper).otherwise(node)
    second = F.when((F.col("p_size") > 25) & (F.col("p_partkey") % 5 != 0), second).otherwise(F.lit(""))
    return table(spark, folder, "part").withColumn(
        "body", F.concat(F.lit("<LawSearch><total>1</total>"), node, second, F.lit("</LawSearch>"))
    )


@query(
    """SELECT p_partkey, CAST(0 AS BIGINT) AS pos, p_name AS law_name, p_type AS kind, '/p/' || p_partkey AS link,
        strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS published, '2027-01-01' AS effective
      FROM part
      UNION ALL
      SELECT p_partkey, 1, p_brand, '', '',
        strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d'), '2027-01-01'
      FROM part WHERE p_size > 25 AND p_partkey % 5 <> 0"""
)
def law_xml_explode(spark: SparkSession, folder: str) -> DataFrame:
    answers = _law_answers(spark, folder).select("p_partkey", "body")
    return scan.law_entries(answers).select(
        "p_partkey",
        F.col("feed_pos").alias("pos"),
        "law_name",
        "kind",
        F.col("raw_link").alias("link"),
        dates.compact_date(F.col("raw_published")).alias("published"),
        dates.compact_date(F.col("raw_effective")).alias("effective"),
    )


@query(
    """SELECT p_partkey, unnest(range(1 + p_partkey % 3)) AS pos,
         unnest(list_transform(range(1 + p_partkey % 3), lambda i: p_name || ' ' || i)) AS law_name, p_type AS kind,
         strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS published
       FROM part"""
)
def any_depth_laws(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three laws an answer, each in a section of its own, up to five levels deep."""
    published = F.date_format(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int")), "yyyyMMdd"
    )
    numbers = F.sequence(F.lit(0), (F.col("p_partkey") % 3).cast("int"))
    laws = F.transform(
        numbers,
        lambda i: _nested(
            ((F.col("p_partkey") + i) % 5).cast("int") + 1,
            _law_node(
                "law", True, F.concat(_escaped(F.col("p_name")), F.lit(" "), i.cast("string")), published, F.col("p_type"), F.lit("")
            ),
        ),
    )
    answers = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("<LawSearch>"), F.array_join(laws, ""), F.lit("</LawSearch>")).alias("body")
    )
    return scan.law_entries(answers).select(
        "p_partkey", F.col("feed_pos").alias("pos"), "law_name", "kind", dates.compact_date(F.col("raw_published")).alias("published")
    )


_ORDER_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    f"""SELECT o_orderkey,
      'order ' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' (' || o_orderpriority || ')' END
        || CASE WHEN o_orderkey % 3 = 0 THEN ' · ' || {_ORDER_DAY} || ' 시행' ELSE '' END AS title,
      CASE WHEN o_orderkey % 2 = 0 THEN {_ORDER_DAY} WHEN o_orderkey % 3 = 0 THEN {_ORDER_DAY} ELSE '{AS_OF}' END AS date,
      CASE WHEN o_custkey % 3 = 0 THEN 'https://www.law.go.kr/c/' || o_custkey
           WHEN o_custkey % 3 = 1 THEN 'http://other/' || o_custkey
           ELSE 'https://www.law.go.kr/법령/order ' || o_orderkey END AS url
    FROM orders"""
)
def law_item_build(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy. MM. dd")
    made = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("order "), key.cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderpriority")).alias("kind"),
        dates.compact_date(F.when(key % 2 == 0, day).otherwise(F.lit(""))).alias("published"),
        dates.compact_date(F.when(key % 3 == 0, day).otherwise(F.lit(""))).alias("effective"),
        F.when(customer % 3 == 0, F.concat(F.lit("/c/"), customer.cast("string")))
        .when(customer % 3 == 1, F.concat(F.lit("http://other/"), customer.cast("string")))
        .otherwise(F.lit(""))
        .alias("link"),
    )
    return made.select(
        "o_orderkey",
        readers.law_label(F.col("name"), F.col("kind"), F.col("effective")).alias("title"),
        dates.choose_date(F.col("published"), F.col("effective"), AS_OF).alias("date"),
        urls.law_url(F.col("link"), F.col("name"), readers.LAW_BASE, readers.LAW_ARTICLE_PATH).alias("url"),
    )


@query(
    """WITH asked(category, law, group_rank) AS
        (VALUES ('SMALL', 'ring', 0), ('SMALL', 'wid get', 1), ('LARGE', 'widget', 2), ('LARGE', 'bolt', 3))
    SELECT p_partkey, law, CAST(group_rank AS INTEGER) AS group_rank FROM part JOIN asked
      ON p_type = category AND contains(replace(p_name, ' ', ''), replace(law, ' ', ''))"""
)
def law_name_match(spark: SparkSession, folder: str) -> DataFrame:
    """Requested laws of a category against the names returned for it."""
    returned = table(spark, folder, "part").select("p_partkey", "p_name", F.col("p_type").alias("category"))
    asked = broadcast_if_small(law_group_frame(spark, TRIAL))
    return (
        returned.join(asked, "category")
        .where(readers.law_name_matches(F.col("law"), F.col("p_name")))
        .select("p_partkey", "law", "group_rank")
    )


@query(
    """SELECT p_partkey, p_name, p_brand, p_type FROM part
    QUALIFY row_number() OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_size DESC, p_partkey) = 1"""
)
def law_dedup(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    order = [F.col("p_size").desc(), F.col("p_partkey")]
    return first.exact_dedup(parts, ("p_name", "p_brand", "p_type"), order).select(
        "p_partkey", "p_name", "p_brand", "p_type"
    )


@query(
    """WITH asked(category, law, group_rank) AS
        (VALUES ('SMALL', 'ring', 0), ('SMALL', 'wid get', 1), ('LARGE', 'widget', 2), ('LARGE', 'bolt', 3)),
    answers AS (
      SELECT p_partkey, p_name, p_type, law, group_rank,
        strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%Y-%m-%d') AS published
      FROM part JOIN asked ON p_type = category AND group_rank % 2 = p_partkey % 2
      WHERE contains(replace(p_name, ' ', ''), replace(law, ' ', '')))
    SELECT p_name || ' (' || p_type || ') · 2027-01-01 시행' AS title,
      'https://www.law.go.kr/p/' || p_partkey AS url, p_type AS category, published AS date,
      CAST(group_rank AS INTEGER) AS group_rank
    FROM answers QUALIFY row_number() OVER (PARTITION BY p_name, published ORDER BY group_rank, lpad(p_partkey::VARCHAR, 12, '0')) = 1"""
)
def law_registry_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole law reader: each part answers a request of its category."""
    odd = F.col("p_partkey") % 2 == 1
    asked = (
        F.when((F.col("p_type") == "SMALL") & ~odd, F.lit("ring"))
        .when((F.col("p_type") == "SMALL") & odd, F.lit("wid get"))
        .when((F.col("p_type") == "LARGE") & ~odd, F.lit("widget"))
        .when((F.col("p_type") == "LARGE") & odd, F.lit("bolt"))
    )
    answers = _law_answers(spark, folder).select(
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("payload_id"),
        F.col("p_type").alias("category"),
        asked.alias("query"),
        "body",
    )
    return readers.law_registry(answers, TRIAL, AS_OF).select("title", "url", "category", "date", "group_rank")


_ANCHORS = """anchors AS (
  SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS title, unnest(h) AS href FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h
    FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS html FROM pages)))"""


@query(
    f"""WITH {_ANCHORS}
    SELECT page_id, pos, trim(replace(title, '&amp;', '&')) AS title, replace(href, '&amp;', '&') AS href
    FROM anchors WHERE length(trim(replace(title, '&amp;', '&'))) >= 6"""
)
def html_anchor_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _anchors(spark, folder).select(
        "page_id", F.col("feed_pos").alias("pos"), F.col("raw_title").alias("title"), F.col("raw_link").alias("href")
    )


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("body"))
    return scan.anchor_entries(pages).where(F.char_length("raw_title") >= readers.MIN_ANCHOR_TITLE)


@query(
    f"""WITH {_ANCHORS}
    SELECT page_id, pos, trim(replace(title, '&amp;', '&')) AS title FROM anchors
    WHERE length(trim(replace(title, '&amp;', '&'))) >= 6
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 2"""
)
def anchor_cap(spark: SparkSession, folder: str) -> DataFrame:
    """First two long anchors of each page: a cap small enough to bite here."""
    return first.cap(_anchors(spark, folder), ["page_id"], 2).select(
        "page_id", F.col("feed_pos").alias("pos"), F.col("raw_title").alias("title")
    )


@query(
    f"""WITH {_ANCHORS}
    SELECT page_id, pos, trim(replace(title, '&amp;', '&')) AS title, replace(href, '&amp;', '&') AS href,
      trim(replace(title, '&amp;', '&')) AS row_text, '2025-02-01' AS date
    FROM anchors WHERE trim(title) <> ''"""
)
def html_row_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("body"))
    return scan.row_link_entries(pages, scan.LIST_ROWS).select(
        "page_id",
        F.col("feed_pos").alias("pos"),
        F.col("raw_title").alias("title"),
        F.col("raw_link").alias("href"),
        "row_text",
        dates.board_date(F.col("row_text"), AS_OF).alias("date"),
    )


@query(
    f"""WITH {LINES}, d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
      told AS (
        SELECT doc_id, pos, CAST(pos AS VARCHAR) AS title, 'entry ' || pos AS own,
          CASE WHEN pos % 3 = 1 AND pos + 1 < n THEN 'entry ' || (pos + 1) END AS held
        FROM lines JOIN d USING (doc_id))
      SELECT doc_id, pos, title, '/l/' || title AS link, concat_ws(' ', own, held) AS row_text FROM told"""
)
def nested_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Board rows; each third one holds a table of its own with the row after it.  Some rows are not closed."""
    lines = F.split("text", "\n")

    def row(pos: Column) -> Column:
        number = pos.cast("string")
        link = F.concat(F.lit("<TD title='</tr>'>entry <a href=\"/l/"), number, F.lit('">'), number, F.lit("</a>"))
        return F.concat(F.lit("<tr class='x'>"), link)

    n = F.size(lines)
    rows = F.transform(
        lines,
        lambda line, pos: F.concat(
            row(pos),
            F.when((pos % 3 == 1) & (pos + 1 < n), F.lit("<table><tbody>"))
            .when(pos % 3 == 2, F.when(pos % 2 == 0, F.lit("</td></tr></tbody></table></td></tr>")).otherwise(F.lit("</table></tr>")))
            .when(pos % 4 == 0, F.lit(""))
            .otherwise(F.lit("</TD></TR>")),
        ),
    )
    # A row outside any table body, and a row in a comment.
    page = F.concat(
        F.lit("<tr><td><a href='/no'>no</a></td></tr><!-- <tr><a href='/no'>no</a> --><table><thead><tr><td>head</td></tr></thead><tbody>"),
        F.array_join(rows, "\n"),
        F.lit("</tbody></table>"),
    )
    pages = _documents(spark, folder).select("doc_id", page.alias("body"))
    return scan.row_link_entries(pages).select(
        "doc_id", F.col("feed_pos").alias("pos"), F.col("raw_title").alias("title"), F.col("raw_link").alias("link"), "row_text"
    )


# Raw attempts: three per document.  A third of the first attempts succeed, the
# second ones answer with a short body, the third ones with a feed.

_KIND = {"en": "regulator_rss", "fr": "search_news", "de": "portal_news", "es": "regulator_rss"}


def attempts(spark: SparkSession, folder: str, answered: bool = False, ranks: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``answered``: every request has a sound answer, in its first or third attempt; else some are cut or fail.

    A document's feed is made once, before its attempts.
    """
    kind = F.lit(None).cast("string")
    for lang, name in _KIND.items():
        kind = F.when(F.col("lang") == lang, F.lit(name)).otherwise(kind)
    attempt = F.col("attempt_rank")
    feed = F.when(
        F.col("lang") == "fr", _feed_of_lines(lambda t: F.concat(t, F.lit(" - "), F.col("source")))
    ).when(F.col("lang") == "de", _news_of_lines()).otherwise(_feed_of_lines(lambda t: t))
    body = (
        F.when(attempt == 1, F.lit("<rss>busy</rss>"))
        .when((F.col("doc_id") % 11 == 0) & F.lit(not answered), F.concat(F.lit("<rss><channel><item><title>cut"), F.repeat(F.lit(" "), 100)))
        .otherwise(F.col("feed"))
    )
    ok = (
        F.when(attempt == 0, F.col("doc_id") % 3 == 0)
        .when(attempt == 1, F.col("doc_id") % 2 == 0)
        .otherwise((F.col("doc_id") % 13 != 1) | F.lit(answered))
    )
    # The feed uses the document's own source, so it is made before that name is reused.
    fed = _documents(spark, folder).select("doc_id", "lang", (feed if {*ranks} - {1} else F.lit(None).cast("string")).alias("feed"))
    tried = fed.withColumn("attempt_rank", F.explode(F.array(*[F.lit(i) for i in ranks])))
    return conform(
        tried.withColumn("body", body).select(
            F.concat_ws("-", payload_id(), attempt.cast("string")).alias("payload_id"),
            payload_id().alias("request_id"),
            kind.alias("source"),
            F.col("lang").alias("category"),
            "attempt_rank",
            ok.alias("status_ok"),
            "body",
        ),
        RAW,
    )


def raw_table(spark: SparkSession, folder: str, answered: bool = False) -> DataFrame:
    """The attempts as a capture job leaves them: files, one folder per source."""
    path = shared_folder(spark, "raw")
    attempts(spark, folder, answered).write.partitionBy("source").parquet(path)
    return spark.read.schema(RAW).parquet(path)


# Which attempt a document's request uses: 0, 2 or none.
_USED = "CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 13 <> 1 THEN 2 END"
# The same where every request is answered.
_ANSWER = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END"


@query(
    """SELECT page_id, octet_length(encode(html)) >= 100 AS ok,
      octet_length(encode(html)) >= 100 AND (contains(html, '<item') OR contains(html, '<rss') OR contains(html, '<?xml')
        OR contains(html, '<law') OR contains(html, '<LawSearch') OR contains(html, '<channel')) AS ok_xml
      FROM pages
      UNION ALL SELECT -1 - doc_id, octet_length(encode(text)) >= 100, FALSE FROM documents"""
)
def payload_gate(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", F.col("html").alias("body"))
    docs = table(spark, folder, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"), F.col("text").alias("body")
    )
    return pages.unionByName(docs).select(
        "page_id",
        payload.looks_ok(F.col("body"), False).alias("ok"),
        payload.looks_ok(F.col("body"), True).alias("ok_xml"),
    )


@query(
    f"""SELECT lpad(doc_id::VARCHAR, 12, '0') AS request_id, {_USED} AS attempt_rank FROM documents
    WHERE {_USED} IS NOT NULL"""
)
def best_attempt(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds need an XML mark in later attempts, JSON answers only their length."""
    raw = attempts(spark, folder)
    contested = payload.contested_requests(raw)
    portal = F.col("source") == "portal_news"
    feeds = payload.best_attempts(raw.where(~portal), True, contested)
    news = payload.best_attempts(raw.where(portal), False, contested)
    return feeds.unionByName(news).select("request_id", "attempt_rank")


# Runs keep all entries; caps have queries of their own.
_INGEST_TRIAL = TRIAL.replace(search_cap=None, portal_cap=None)
_RUN_SOURCES = (
    readers.Source("regulator_rss", readers.regulator_rss),
    readers.Source("search_news", readers.search_news),
    readers.Source("portal_news", readers.portal_news, "news", needs_xml=False),
)

# A short body is an answer for the portal, whose answers need no XML mark, only
# if it is long enough; the one of the second attempt is not.
def _ingested_sql(used: str) -> str:
    return f"""{ITEMS}, used AS ({used}),
regulated AS (
  SELECT doc_id, pos, '금융위원회' AS source, {text(OFFICIAL)} AS source_type,
    {classify_sql('clean', TRIAL.regulator_rules)} AS category, clean AS title, url, date, 100 AS trust, 0 AS source_rank
  FROM used WHERE category IN ('en', 'es') AND NOT {any_of('clean', TRIAL.regulator_exclude)}),
searched AS (
  SELECT doc_id, pos, coalesce({trust_sql('url', what='name')}, source) AS source, '뉴스' AS source_type, category,
    clean AS title, url, date, {trust_sql('url')} AS trust, 1 AS source_rank
  FROM used WHERE category = 'fr' AND NOT {exclude_sql('clean', TRIAL, 'source')} AND {match_sql('clean', 'category')}),
listed AS (
  SELECT doc_id, pos, category, trim(regexp_replace(clean, '<[^>]+>', '', 'g')) AS title, date,
    CASE WHEN pos % 2 = 0 THEN url ELSE 'https://portal.example/' || url END AS url
  FROM used WHERE category = 'de'),
portal AS (
  SELECT doc_id, pos, coalesce({trust_sql('url', what='name')}, '네이버뉴스') AS source, '뉴스' AS source_type, category,
    title, url, date, {trust_sql('url')} AS trust, 2 AS source_rank
  FROM listed WHERE NOT {exclude_sql('title')} AND {match_sql('title', 'category', strict=False)}),
ingested AS (
  SELECT * FROM regulated WHERE category IS NOT NULL
  UNION ALL BY NAME SELECT * FROM searched UNION ALL BY NAME SELECT * FROM portal)"""


_CLEANED = f"SELECT items.*, {clean_sql('title')} AS clean FROM items"
INGESTED = _ingested_sql(_CLEANED)
# Only requests whose answer is sound.
SOUND = _ingested_sql(f"{_CLEANED} WHERE {_USED} IS NOT NULL AND doc_id % 11 <> 0")


@query(f"WITH {INGESTED} SELECT doc_id, pos, source, source_type, category, title, url, date, trust FROM ingested")
def ingest_run(spark: SparkSession, folder: str) -> DataFrame:
    """Three sources of one run, from raw attempts to items."""
    found = ingest(raw_table(spark, folder, answered=True), _INGEST_TRIAL, AS_OF, 1, _RUN_SOURCES)
    return _shown(found)


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        F.substring("payload_id", 1, 12).cast("long").alias("doc_id"),
        F.col("feed_pos").alias("pos"),
        "source",
        "source_type",
        "category",
        "title",
        "url",
        "date",
        "trust",
    )


KEYED = f"""{INGESTED},
keyed AS (
  SELECT *, {_ANSWER} AS attempt, source_type = {text(OFFICIAL)} AS is_off,
    CASE WHEN source_type = {text(OFFICIAL)} THEN title ELSE {key_sql('title')} END AS k1,
    CASE WHEN source_type = {text(OFFICIAL)} THEN date ELSE '' END AS k2
  FROM ingested)"""

JOBBED = f"""{KEYED},
jobbed AS (
  SELECT * FROM (
    SELECT * FROM keyed WHERE is_off OR k1 <> ''
    QUALIFY row_number() OVER (PARTITION BY is_off, k1, k2 ORDER BY source_rank, doc_id, pos) = 1)
  WHERE is_off OR date >= strftime(DATE '{AS_OF}' - 180, '%Y-%m-%d'))"""

_JOB_SQL = f"WITH {JOBBED} SELECT doc_id, pos, source, source_type, category, title, url, date, trust FROM jobbed"


@query(_JOB_SQL)
def job_run(spark: SparkSession, folder: str) -> DataFrame:
    """A whole run: ingest, merge into an empty store, write it, read it back."""
    done = run_job(
        spark,
        raw_table(spark, folder, answered=True),
        shared_folder(spark, "job"),
        _INGEST_TRIAL,
        AS_OF,
        1,
        _RUN_SOURCES,
    )
    return _shown(done.items)


@query(
    f"""WITH {SOUND}, kinds AS (
      SELECT doc_id, lang AS category, CASE lang WHEN 'fr' THEN 'search_news' WHEN 'de' THEN 'portal_news' ELSE 'regulator_rss' END AS source,
        {_USED} AS attempt FROM documents),
    asked AS (
      SELECT source, category, count(*) AS requests, count(*) FILTER (attempt IS NULL) AS no_answer,
        count(*) FILTER (attempt IS NOT NULL AND doc_id % 11 = 0) AS broken
      FROM kinds GROUP BY ALL),
    got AS (
      SELECT CASE source_rank WHEN 0 THEN 'regulator_rss' WHEN 1 THEN 'search_news' ELSE 'portal_news' END AS source,
        category, count(*) AS rows FROM ingested GROUP BY ALL)
    SELECT source, category, coalesce(requests, 0) AS requests, coalesce(no_answer, 0) AS no_answer,
      coalesce(broken, 0) AS broken, coalesce(rows, 0) AS rows FROM asked FULL JOIN got USING (source, category)"""
)
def intake_report(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_table(spark, folder)
    found = ingest(raw, _INGEST_TRIAL, AS_OF, 1, _RUN_SOURCES)
    names = F.array(*[F.lit(s.name) for s in _RUN_SOURCES])
    rows = found.select(F.get(names, F.col("source_rank")).alias("source"), "category")
    return profile.intake_report(request_outcomes(raw, _RUN_SOURCES), rows)


@query(
    f"""WITH kinds AS (
      SELECT doc_id, CASE lang WHEN 'fr' THEN 'search_news' WHEN 'de' THEN 'portal_news' ELSE 'regulator_rss' END AS source,
        {_USED} AS attempt FROM documents)
    SELECT source, CASE WHEN attempt IS NULL THEN 'no answer' ELSE 'broken payload' END AS failure, count(*) AS n
    FROM kinds WHERE attempt IS NULL OR doc_id % 11 = 0 GROUP BY ALL"""
)
def failure_list(spark: SparkSession, folder: str) -> DataFrame:
    return profile.failure_list(request_outcomes(attempts(spark, folder), _RUN_SOURCES))


@query(
    """WITH shown AS (
      SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>', '', 'g') AS html FROM pages),
    tags AS (
      SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([A-Za-z_\\x{AC00}-\\x{D7A3}][^\\s/>]*)', 1)) AS tag FROM shown)
    SELECT tag, count(*) AS payloads FROM tags GROUP BY tag ORDER BY tag LIMIT 12"""
)
def tag_profile(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("html").alias("body"))
    return profile.tag_profile(pages)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream, one row per user and type within 180 days."""
    events = (
        spark.readStream.schema(table(spark, folder, "events").schema)
        .option("pathGlobFilter", "events*.parquet")
        .parquet(folder)
        .select("ts", "user_id", "event_type")
    )
    unique = intake.stream_unique(events, "ts", ["user_id", "event_type"])
    out = shared_folder(spark, "stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    intake.use_disk_state(spark)
    try:
        written = intake.write_stream(unique, f"{out}/rows", f"{out}/checkpoint")
    finally:
        spark.conf.set(provider, before)  # the stream keeps what it began with
    written.awaitTermination()
    return spark.read.schema(unique.schema).parquet(f"{out}/rows").select("user_id", "event_type")


_GENERATION = """SELECT * FROM keyed WHERE attempt = {} AND (is_off OR k1 <> '')
    QUALIFY row_number() OVER (PARTITION BY is_off, k1, k2 ORDER BY source_rank, doc_id, pos) = 1"""
_FRESH = f"(is_off OR date >= strftime(DATE '{AS_OF}' - 180, '%Y-%m-%d'))"
_STILL_FITS = f"(is_off OR source IN ('src3', 'src7') OR (NOT {exclude_sql('title')} AND {match_sql('title', 'category')}))"


@query(
    f"""WITH {KEYED}, early AS ({_GENERATION.format(0)}), late AS ({_GENERATION.format(2)}),
    streamed AS (
      SELECT * FROM late WHERE {_FRESH}
      UNION ALL SELECT * FROM early WHERE {_FRESH} AND {_STILL_FITS}
        AND (is_off, k1, k2) NOT IN (SELECT (is_off, k1, k2) FROM late))
    SELECT doc_id, pos, source, source_type, category, title, url, date, trust FROM streamed"""
)
def stream_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Raw payloads as a stream: the attempts of a request arrive in three batches.

    A request answered by its first attempt stays with it, and each batch is a run,
    so stored rows are checked anew and give way to rows of the same key.
    """
    base = shared_folder(spark, "stream-merge")
    for attempt in range(3):
        arrived = attempts(spark, folder, answered=True, ranks=[attempt])
        arrived.write.mode("append").parquet(f"{base}/raw")
        intake.stream_job(
            intake.raw_stream(spark, f"{base}/raw"),
            f"{base}/store",
            f"{base}/checkpoint",
            _INGEST_TRIAL,
            AS_OF,
            _RUN_SOURCES,
        ).awaitTermination()
    return _shown(read_store(spark, f"{base}/store"))
