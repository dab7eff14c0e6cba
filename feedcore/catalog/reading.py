"""Summaries, browsing and the calendar over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.catalog.registry import case, query, text
from feedcore.catalog.sets import FEED_ORDER, SCORED, scored
from feedcore.catalog.views import OFFICIAL, ORDER_ITEMS, TRIAL, order_items
from feedcore.functions import dates
from feedcore.functions import summary as sentences
from feedcore.functions.matching import is_official
from feedcore.functions.text import short_name
from feedcore.operators import browse, calendar
from feedcore.rules import SHIPPED

_W = SHIPPED.wording
_NAME = "trim(regexp_extract(title, '^[^(·]*', 0))"
_EFFECTIVE = "regexp_extract(title, '([0-9]{4}-[0-9]{2}-[0-9]{2})\\s*시행', 1)"
_KIND = (
    "coalesce(nullif(regexp_extract(title, '(일부개정|전부개정|타법개정|제정)', 1), ''), '개정')"
)
_OFF = f"source_type = {text(OFFICIAL)}"


@query(
    f"""WITH {ORDER_ITEMS} SELECT o_orderkey,
      CASE WHEN {_OFF} THEN '「' || {_NAME} || '」 관련 ' || category || ' 규정이 ' || {_KIND} || '되었습니다.'
           ELSE source || '가 보도한 ' || category || ' 분야 동향입니다.' END AS line1,
      CASE WHEN {_OFF} AND {_EFFECTIVE} <> '' THEN replace({text(_W.official_dated)}, '{{date}}', {_EFFECTIVE})
           WHEN {_OFF} THEN {text(_W.official_undated)} ELSE {text(_W.other_second)} END AS line2
    FROM order_items"""
)
def summary_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = order_items(spark, folder)
    lines = sentences.summary_lines(
        F.col("title"),
        F.col("category"),
        F.col("source"),
        is_official(F.col("source_type"), SHIPPED),
        SHIPPED,
    )
    return found.select("o_orderkey", lines.alias("l")).select(
        "o_orderkey", F.get("l", 0).alias("line1"), F.get("l", 1).alias("line2")
    )


@query(
    f"""WITH {ORDER_ITEMS} SELECT o_orderkey,
      CASE WHEN {_OFF} THEN '「' || {_NAME} || '」 관련 ' || category || ' 개정 사항입니다.'
          || CASE WHEN {_EFFECTIVE} <> '' THEN ' ' || {_EFFECTIVE} || '부터 시행됩니다.' ELSE '' END
          || {text(_W.page_official_end)}
        ELSE replace(replace({text(_W.page_other)}, '{{source}}', source), '{{category}}', category) END AS summary
    FROM order_items"""
)
def feed_summary(spark: SparkSession, folder: str) -> DataFrame:
    shown = sentences.page_summary(
        F.col("title"),
        F.col("category"),
        F.col("source"),
        is_official(F.col("source_type"), SHIPPED),
        SHIPPED,
    )
    return order_items(spark, folder).select("o_orderkey", shown.alias("summary"))


_SEED = "list_sum(list_transform(string_split(substr(title, 1, 10), ''), lambda c: unicode(c)))"
_IMPACT = case(
    [
        (f"category = {text(c)} AND {_SEED} % {len(ts)} = {i}", text(t))
        for c, ts in SHIPPED.impact.items()
        for i, t in enumerate(ts)
    ]
    + [
        (f"{_SEED} % {len(SHIPPED.impact[SHIPPED.impact_default])} = {i}", text(t))
        for i, t in enumerate(SHIPPED.impact[SHIPPED.impact_default])
    ],
    "NULL",
)


@query(
    f"""WITH {ORDER_ITEMS}, {SCORED}, titles AS (
      SELECT 'order' AS kind, o_orderkey AS id, title, category FROM order_items
      UNION ALL SELECT 'line', doc_id * 100000 + pos, title, category FROM scored)
    SELECT kind, id, {_IMPACT} AS impact FROM titles"""
)
def impact_pick(spark: SparkSession, folder: str) -> DataFrame:
    titles = order_items(spark, folder).select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), "title", "category"
    )
    lines = scored(spark, folder).select(
        F.lit("line").alias("kind"),
        (F.col("doc_id") * 100000 + F.col("pos")).alias("id"),
        "title",
        "category",
    )
    return titles.unionByName(lines).select(
        "kind", "id", sentences.impact_pick(F.col("title"), F.col("category"), SHIPPED).alias("impact")
    )


@query(
    f"""WITH {ORDER_ITEMS} SELECT o_orderkey, strftime(CAST({_EFFECTIVE} AS DATE), '%Y-%m-%d') AS effective,
          {_NAME} AS name FROM order_items WHERE {_EFFECTIVE} <> ''"""
)
def enforcement_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = order_items(spark, folder).select(
        "o_orderkey",
        dates.effective_date(F.col("title")).cast("string").alias("effective"),
        short_name(F.col("title")).alias("name"),
    )
    return found.where(F.col("effective").isNotNull())


_SEARCH = """(contains(title, 'tion') OR contains(source, 'tion'))
    AND date >= '2024-03-01' AND date <= '2024-11-30'"""
_FILTERS = {"text": " tion ", "date_from": "2024-03-01", "date_to": "2024-11-30"}


@query(
    f"""WITH {SCORED} SELECT doc_id, pos, title, date,
      CASE WHEN {_OFF} THEN '「' || {_NAME} || '」 관련 ' || category || ' 개정 사항입니다.' || {text(_W.page_official_end)}
        ELSE replace(replace({text(_W.page_other)}, '{{source}}', source), '{{category}}', category) END AS page_summary
    FROM scored WHERE {_SEARCH} AND category = 'en' ORDER BY date DESC, {FEED_ORDER}"""
)
def feed_search(spark: SparkSession, folder: str) -> DataFrame:
    return browse.feed_search(scored(spark, folder), TRIAL, category="en", **_FILTERS).select(
        "doc_id", "pos", "title", "date", "page_summary"
    )


@query(f"WITH {SCORED} SELECT count(*) AS n FROM scored WHERE {_SEARCH}")
def feed_search_count(spark: SparkSession, folder: str) -> DataFrame:
    return browse.search_count(scored(spark, folder), category=browse.ALL, **_FILTERS)


@query(
    f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER ({_OFF}) AS official,
      count(*) FILTER (NOT {_OFF}) AS other, count(DISTINCT category) AS categories FROM scored"""
)
def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    return browse.dashboard_stats(scored(spark, folder), TRIAL)


@query(f"WITH {SCORED} SELECT category, count(*) AS n FROM scored GROUP BY category")
def count_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return browse.count_by_category(scored(spark, folder))


_CODE = case([(f"category = {text(c)}", text(v)) for c, v in SHIPPED.codes.items()], "''")
_EVENTS = f"""{ORDER_ITEMS}, enforcements AS (
  SELECT o_orderkey, CAST({_EFFECTIVE} AS DATE) AS eff_date, {_NAME} AS name, category, {_CODE} AS code
  FROM order_items WHERE {_EFFECTIVE} <> '')"""


@query(
    f"""WITH {_EVENTS}, days AS (
      SELECT CAST(unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT strftime(d, '%Y-%m-%d') AS eff_date, CAST(day(d) AS INTEGER) AS day,
      CAST(dayofweek(DATE '1998-06-01') + day(d) - 1 AS INTEGER) AS cell,
      d = DATE '1998-06-15' AS is_today,
      coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM enforcements e WHERE e.eff_date = d), '') AS codes
    FROM days"""
)
def month_calendar(spark: SparkSession, folder: str) -> DataFrame:
    events = calendar.enforcement_events(order_items(spark, folder), SHIPPED)
    grid = calendar.month_calendar(events, 1998, 6, "1998-06-15")
    return grid.select(
        F.col("eff_date").cast("string").alias("eff_date"),
        "day",
        "cell",
        "is_today",
        F.array_join("codes", ",").alias("codes"),
    )


@query(
    f"""WITH {_EVENTS}
    SELECT strftime(eff_date, '%Y-%m-%d') AS eff_date, name, category, code, o_orderkey,
      CAST(eff_date - DATE '1998-11-30' AS INTEGER) AS days_left, eff_date - DATE '1998-11-30' <= 30 AS soon
    FROM enforcements WHERE eff_date BETWEEN DATE '1998-11-30' AND DATE '1999-03-02'
    ORDER BY eff_date, o_orderkey LIMIT 6"""
)
def upcoming_dday(spark: SparkSession, folder: str) -> DataFrame:
    events = calendar.enforcement_events(order_items(spark, folder), SHIPPED, ["o_orderkey"])
    found = calendar.upcoming(events, "1998-11-30", [F.col("o_orderkey")])
    return found.withColumn("eff_date", F.col("eff_date").cast("string"))
