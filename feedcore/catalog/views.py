"""Item views over the given tables, and rules made of words that occur in them.

Every line of every document is one item.  Each view exists twice: as a
DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.catalog.registry import any_of, case, table, text
from feedcore.rules import SHIPPED, CategoryRule, KeywordRule, RuleBook, TrustRule

OFFICIAL = SHIPPED.official_type
NEWS = SHIPPED.news_type
AS_OF = "2024-12-31"

#: Rules made of word pieces that occur in the documents.
TRIAL: RuleBook = SHIPPED.replace(
    categories=(
        CategoryRule("en", ("tion", "ther", "ound"), ("heth", "esin", "andth", "ionou", "hai")),
        CategoryRule("fr", ("eau", "ment"), ("oire", "elle", "quevi")),
        CategoryRule("de", ("ung", "keit"), ("lich", "pfung", "sch")),
    ),
    noise=("!!", " | ", "ingthe", "Odies"),
    ads=("***", "$$$", "[AD]", "heerth"),
    low_quality_sources=("src11", "src4"),
    trust=(
        TrustRule("src1.", 100, "One"),
        TrustRule("src1", 80, "Teens"),
        TrustRule("cheap-pills", 5, "Pills"),
        TrustRule("blog.", 70, "Blogs"),
        TrustRule("example.org", 60, "Org"),
        TrustRule("/de/", 50, "German"),
        TrustRule("www.", 40, "Web"),
    ),
    official_links={
        "en": (("Gazette", "https://gazette.example.com/"), ("Register", "https://register.example.com/")),
        "fr": (("Journal", "https://journal.example.org/"),),
    },
    migration={"es": "fr"},
    allowed=("en", "fr", "de"),
    official_sources=("src3", "src7"),
    regulator_rules=(
        KeywordRule("de", ("andth", "heth")),
        KeywordRule("fr", ("tion", "eau")),
        KeywordRule("en", ("the", "ing", "ung")),
    ),
    regulator_exclude=("!!", " | ", "***"),
    ministry_keywords=("tion", "ment", "ung", "ción"),
    law_groups={"SMALL": ("ring", "wid get"), "LARGE": ("widget", "bolt"), "PROMO": ()},
)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "title")
    ).withColumn("pos", F.col("pos").cast("long"))


LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS title,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents)"""


def _url() -> Column:
    return F.concat(
        F.lit("https://"),
        F.when(F.col("pos") % 3 == 0, F.lit("www.")).otherwise(F.lit("")),
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
        F.col("pos").cast("string"),
    )


URL_SQL = """'https://' || CASE WHEN pos % 3 = 0 THEN 'www.' ELSE '' END || source || '.example.'
    || CASE lang WHEN 'en' THEN 'com' WHEN 'fr' THEN 'org' ELSE 'net' END
    || '/' || lang || '/' || doc_id || '/' || pos"""

DATE_SQL = "(DATE '2024-01-01' + CAST((doc_id * 7 + pos) % 400 AS INTEGER))"


def _day() -> Column:
    offset = ((F.col("doc_id") * 7 + F.col("pos")) % 400).cast("int")
    return F.date_add(F.lit("2024-01-01").cast("date"), offset)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One item per document line, in document order."""
    return lines(spark, folder).select(
        "doc_id",
        "pos",
        "source",
        F.col("lang").alias("category"),
        "title",
        _url().alias("url"),
        F.date_format(_day(), "yyyy-MM-dd").alias("date"),
        F.when(F.col("source").isin("src3", "src7"), F.lit(OFFICIAL))
        .otherwise(F.lit(NEWS))
        .alias("source_type"),
        F.lit(0).cast("long").alias("run_seq"),
        F.lit(0).alias("source_rank"),
        F.lit(0).alias("group_rank"),
        payload_id().alias("payload_id"),
        F.col("pos").alias("feed_pos"),
    )


def payload_id() -> Column:
    return F.lpad(F.col("doc_id").cast("string"), 12, "0")


ITEMS = f"""{LINES}, items AS (
  SELECT doc_id, pos, source, lang AS category, title, {URL_SQL} AS url,
         strftime({DATE_SQL}, '%Y-%m-%d') AS date,
         CASE WHEN source IN ('src3', 'src7') THEN {text(OFFICIAL)} ELSE {text(NEWS)} END AS source_type
  FROM lines)"""


def key_sql(column: str) -> str:
    return (
        f"substr(lower(regexp_replace(regexp_replace({column}, '\\[[^\\]]*\\]', '', 'g'), "
        "'[^가-힣a-zA-Z0-9]', '', 'g')), 1, 24)"
    )


def clean_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def trust_sql(column: str, rules: RuleBook = TRIAL, what: str = "score") -> str:
    values = [str(t.score) if what == "score" else text(t.name) for t in rules.trust]
    whens = [
        (f"contains(lower({column}), {text(t.fragment)})", v) for t, v in zip(rules.trust, values)
    ]
    return case(whens, str(rules.default_trust) if what == "score" else "NULL")


def match_sql(column: str, category: str, rules: RuleBook = TRIAL, strict: bool = True) -> str:
    whens = []
    for r in rules.categories:
        test = any_of(column, r.must)
        if strict:
            test = f"({test} AND {any_of(column, r.combine)})"
        whens.append((f"{category} = {text(r.category)}", test))
    return case(whens, "FALSE")


def classify_sql(column: str, ordered) -> str:
    return case([(any_of(column, r.keywords), text(r.category)) for r in ordered], "NULL")


def exclude_sql(column: str, rules: RuleBook = TRIAL, outlet: str | None = None) -> str:
    words = any_of(column, (*rules.noise, *rules.ads))
    return f"({words} OR {any_of(outlet, rules.low_quality_sources)})" if outlet else words


def links_sql(column: str, rules: RuleBook = TRIAL) -> str:
    whens = [
        (f"{column} = {text(c)}", text(";".join(f"{label}={url}" for label, url in links)))
        for c, links in rules.official_links.items()
    ]
    return case(whens, "''")


def links_text(column: str = "official") -> Column:
    """Links as one text, for comparison."""
    return F.array_join(
        F.transform(F.col(column), lambda x: F.concat_ws("=", x["label"], x["url"])), ";"
    )


# Orders as items: titles with a kind of change and an effective date.

_PRIORITY = {
    "1-URGENT": "세법",
    "2-HIGH": "K-IFRS",
    "3-MEDIUM": "내부회계",
    "4-NOT SPECIFIED": "ESG",
}
OTHER_CATEGORY = "기타"


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    category = F.lit(OTHER_CATEGORY)
    for priority, name in _PRIORITY.items():
        category = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(category)
    kind = (
        F.when(F.col("o_orderstatus") == "F", F.lit(" (일부개정)"))
        .when(F.col("o_orderstatus") == "O", F.lit(" (제정)"))
        .otherwise(F.lit(""))
    )
    effective = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 90).cast("int"))
    dated = F.when(
        F.col("o_orderkey") % 4 != 3,
        F.concat(F.lit(" · "), F.date_format(effective, "yyyy-MM-dd"), F.lit(" 시행")),
    ).otherwise(F.lit(""))
    name = F.concat(F.lit("규정 "), F.col("o_orderkey").cast("string"), F.lit("호"))
    return orders.select(
        F.col("o_orderkey"),
        F.concat(name, kind, dated).alias("title"),
        category.alias("category"),
        F.concat(F.lit("desk"), (F.col("o_custkey") % 10).cast("string")).alias("source"),
        F.when(F.col("o_orderstatus") == "P", F.lit(NEWS)).otherwise(F.lit(OFFICIAL)).alias("source_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


ORDER_ITEMS = f"""order_items AS (
  SELECT o_orderkey,
    '규정 ' || o_orderkey || '호'
      || CASE o_orderstatus WHEN 'F' THEN ' (일부개정)' WHEN 'O' THEN ' (제정)' ELSE '' END
      || CASE WHEN o_orderkey % 4 <> 3
           THEN ' · ' || strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER), '%Y-%m-%d') || ' 시행'
           ELSE '' END AS title,
    {case([(f"o_orderpriority = {text(p)}", text(c)) for p, c in _PRIORITY.items()], text(OTHER_CATEGORY))} AS category,
    'desk' || (o_custkey % 10) AS source,
    CASE WHEN o_orderstatus = 'P' THEN {text(NEWS)} ELSE {text(OFFICIAL)} END AS source_type,
    strftime(o_orderdate, '%Y-%m-%d') AS date
  FROM orders)"""
