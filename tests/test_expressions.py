"""Text, date, URL and summary expressions on awkward values."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from feedcore.functions import dates, matching, summary, text, urls
from feedcore.rules import SHIPPED

SPACES = [chr(n) for n in range(0x3001) if chr(n).isspace()]
NOT_SPACES = ["᠎", "​", "﻿", "­"]


def random_texts(seed, pieces, n=3000, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_unescape_equals_the_standard_library(column):
    names = random.Random(1).sample(sorted(html.entities.html5), 300)
    pieces = (
        [f"&{n}" for n in names]
        + ["&amp;", "&lt;", "&gt;", "&nbsp;", "&quot;", "&#39;", "&apos;", "&amp", "&#", "&#x", "&", ";", "#", " "]
        + ["&notit;", "&unknown;", "&copyfoo", "amp;", "lt;", "x", "가", "\n", "<"]
        + [f"&#{n};" for n in (0, 1, 9, 10, 13, 65, 127, 128, 129, 159, 160, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x110000, 10**12)]
        + [f"&#x{n:X}" for n in (0, 0x41, 0x80, 0x9F, 0xAC00, 0x1FFFF, 0x10FFFF, 0x10FFFE)]
        + ["&#0000065;", "&#x0000041;", "&" + "a" * 40 + ";"]
    )
    values = random_texts(2, pieces) + [f"&{n}" for n in sorted(html.entities.html5)]
    assert column(values, text.unescape) == [html.unescape(v) for v in values]


def test_clean_text_equals_python(column):
    pieces = SPACES + NOT_SPACES + ["a", "b", "  ", "&nbsp;", "&amp;", "&#32;", "가", "&amp;nbsp;"]
    values = random_texts(3, pieces)
    expected = [html.unescape(re.sub(r"\s+", " ", v)).strip() for v in values]
    assert column(values, text.clean_text) == expected
    assert column([None], text.clean_text) == [""]


def test_strip_tags_equals_python(column):
    pieces = ["<b>", "</b>", "<", ">", "a", " ", "&lt;", "\n", "<br/>", "&amp;", "<>"]
    values = random_texts(4, pieces)
    expected = [html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", v))).strip() for v in values]
    assert column(values, text.strip_tags) == expected


def test_title_key_equals_plain_rule(column):
    pieces = ["[", "]", "[단독]", "가", "힣", "A", "z", "9", " ", "-", "·", "é", "漢", "😀", "abcdefgh", "ㄱ"]
    values = random_texts(5, pieces, most=30)

    def plain(title):
        bare = "".join(re.split(r"\[[^\]]*\]", title))
        return "".join(c for c in bare if "가" <= c <= "힣" or (c.isascii() and c.isalnum())).lower()[:24]

    assert column(values, text.title_key) == [plain(v) for v in values]
    assert column([None, "[only] ---"], text.title_key) == ["", ""]


def test_title_is_split_at_the_last_dash(column):
    values = ["a - b", "a - b - c", "a-b", " - b", "a - ", "a\n - b", ""]
    assert column(values, text.title_without_outlet) == ["a", "a - b", "a-b", "", "a", "a", ""]
    outlets = column(values, lambda c: text.outlet_of_title(c, "none"))
    assert outlets == ["b", "c", "none", "b", "", "b", "none"]


def test_markup_text(column):
    value = "<td><a href='x>y'> <b> Foo </b>b&amp;r<!-- <i>no</i> --> </a> 2026.8.7</td>"
    assert column([value], text.markup_text) == ["Foob&r2026.8.7"]
    assert column([value], lambda c: text.markup_text(c, " ")) == ["Foo b&r 2026.8.7"]


def test_attribute(column):
    tags = [
        '<a class="x" href="/a?b=1&amp;c=2">', "<a HREF = '/q'>", "<a href=/plain>", "<a data-href='no'>",
        "<a title='href=no' href='yes'>", "<a>",
    ]
    found = column(tags, lambda c: text.attribute(c, "href"))
    assert found[:4] == ["/a?b=1&c=2", "/q", "/plain", ""]
    assert found[5] == ""


MAIL = [
    "Fri, 07 Aug 2026 23:30:00 +0900", "Fri, 07 Aug 2026 03:00:00 +0900", "Fri, 07 Aug 2026 03:00:00 GMT",
    "  fri,  7  AUG 2026 3:0:0 +09:00 ", "Sat, 31 Feb 2026 03:00:00 GMT", "Fri, 07 Aug 2026 03:00:00 KST",
    "2026.8.7", "posted 2026-13-45", "2026/08/07", "2026-08-07 10:00:00", "20260807", "", None,
]
TODAY = "2000-01-01"


@pytest.mark.parametrize(
    ("parse", "expected"),
    [
        (dates.press_release_date, ["2026-08-07"] * 4 + [TODAY] * 2 + ["2026-08-07", "2026-13-45", TODAY, "2026-08-07"]),
        (dates.search_feed_date, ["2026-08-07"] * 4 + [TODAY] * 6),
        (dates.news_api_date, ["2026-08-07"] * 2 + [TODAY, "2026-08-07"] + [TODAY] * 6),
        (
            dates.ministry_date,
            ["2026-08-07"] * 2 + [TODAY, "2026-08-07"] + [TODAY] * 2
            + ["2026-08-07", "2026-13-45", "2026-08-07", "2026-08-07"],
        ),
        (dates.board_date, [TODAY] * 6 + ["2026-08-07", "2026-13-45", "2026-08-07", "2026-08-07"]),
    ],
)
def test_publication_dates(column, parse, expected):
    assert column(MAIL, lambda c: parse(c, TODAY)) == expected + [TODAY] * 3


def test_mail_date_equals_strptime(column):
    from datetime import datetime

    rng = random.Random(6)
    names = ["Mon", "tue", "WED", "Xyz"]
    months = ["Jan", "feb", "MAR", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "Abc"]
    values = [
        f"{rng.choice(names)}, {rng.randrange(0, 33):0{rng.choice([1, 2])}d} {rng.choice(months)} "
        f"{rng.randrange(1900, 2100)} {rng.randrange(25)}:{rng.randrange(61):02d}:{rng.randrange(60)} "
        f"{rng.choice(['+0900', '-0430', '+09:00', 'Z', '+9', '0900', ''])}"
        for _ in range(2000)
    ]

    def plain(value):
        try:
            return datetime.strptime(value.strip(), "%a, %d %b %Y %H:%M:%S %z").strftime("%Y-%m-%d")
        except ValueError:
            return TODAY

    assert column(values, lambda c: dates.news_api_date(c, TODAY)) == [plain(v) for v in values]


def test_compact_date(column):
    values = ["20260630", "2026.06.30", " 2026-06-30　", "2026. 6. 30", "", None, "미정", "2026063"]
    expected = ["2026-06-30", "2026-06-30", "2026-06-30", "2026630", "", "", "미정", "2026063"]
    assert column(values, dates.compact_date) == expected


def test_effective_date(column):
    values = ["법 · 2027-01-01 시행", "2027-01-01 시행", "2026-02-30 시행", "2027-01-01 공포", ""]
    assert [str(d) for d in column(values, dates.effective_date)] == [
        "2027-01-01", "2027-01-01", "None", "None", "None",
    ]


def test_months_run_over(column):
    found = column(
        ["2026-11-30", "2026-11-15", "2023-11-30", "2026-10-31"],
        lambda c: dates.months_later(c.cast("date"), 3).cast("string"),
    )
    assert found == ["2027-03-02", "2027-02-15", "2024-03-01", "2027-01-31"]


def test_join_url_equals_the_standard_library(column):
    from urllib.parse import urljoin

    base = "https://www.nts.go.kr"
    values = [
        "", "/a/b", "a/b?c=1", "../x", "./x", "a/./b/../c", "?q=1", "#top", "http://o/p", "//host/p",
        "javascript:void(0)", "mailto:x@y", "/a/../b", "/a/..", "a/..", "../..", "/?x=../y", "a b",
    ]
    expected = [urljoin(base, v) for v in values]
    found = column(values, lambda c: urls.join_url(base, c))
    for value, mine, theirs in zip(values, found, expected):
        if value in ("?q=1", "#top"):  # with or without the root slash: the same page
            assert mine.replace("kr/", "kr") == theirs.replace("kr/", "kr")
        else:
            assert mine.rstrip("/") == theirs.rstrip("/"), value


def test_outlet_from_url(column):
    values = ["https://www.hankyung.com/a", "http://news.mk.co.kr/", "https://n.news.naver.com/x", "", "ftp://x.y"]
    found = column(values, lambda c: urls.outlet_from_url(c, "naver.com", "portal"))
    assert found == ["hankyung", "news", "portal", "portal", "portal"]


def test_trust_first_rule_wins(spark):
    links = ["https://www.KASB.or.kr/x", "https://money.com/a", "https://a/?u=mk.co.kr", "https://x.kr", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "i int, url string")
    rows = urls.with_trust(df, SHIPPED, name="name").orderBy("i").collect()
    assert [(r.trust, r.name) for r in rows] == [
        (100, "한국회계기준원"), (70, "EY(한영)"), (60, "매일경제"), (30, None), (30, None), (30, None),
    ]


@pytest.mark.parametrize("rule", SHIPPED.trust, ids=lambda r: r.fragment)
def test_each_trust_rule_or_an_earlier_one_matches(spark, rule):
    df = spark.createDataFrame([(f"https://{rule.fragment}/x",)], "url string")
    row = urls.with_trust(df, SHIPPED, name="name").first()
    earlier = [t for t in SHIPPED.trust if t.fragment in rule.fragment]
    assert (row.trust, row.name) == (earlier[0].score, earlier[0].name)


def test_every_keyword_triggers_its_list(column):
    for words, test in ((SHIPPED.noise, matching.is_noise), (SHIPPED.ads, matching.is_ad)):
        assert all(column([f"x{w}y" for w in words], lambda c: test(c, SHIPPED)))
    assert column(["아무 일 없음"], lambda c: matching.should_exclude(c, SHIPPED)) == [False]


def test_low_quality_outlet(column):
    found = column(
        ["좋은 블로그", "신문", None], lambda c: matching.is_ad(F.lit("제목"), SHIPPED, c)
    )
    assert found == [True, False, False]


def test_match_needs_both_lists_of_its_own_category(spark):
    rows = [
        ("K-IFRS 개정", "K-IFRS", True, True),
        ("K-IFRS 소식", "K-IFRS", False, True),
        ("K-IFRS 개정", "세법", False, False),
        ("법인세 예규", "세법", True, True),
        ("법인세 예규", "없는 분야", False, False),
        ("법인세 예규", None, False, False),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, c string")
    found = df.select(
        "i",
        matching.match_strict(F.col("t"), F.col("c"), SHIPPED).alias("strict"),
        matching.match_loose(F.col("t"), F.col("c"), SHIPPED).alias("loose"),
    )
    assert [(r.strict, r.loose) for r in found.orderBy("i").collect()] == [r[2:] for r in rows]


def test_classification_takes_the_first_rule(column):
    values = ["내부통제와 ESG 회계", "ESG 회계", "회계와 세법", "세법", "기타", ""]
    found = column(values, lambda c: matching.classify_ordered(c, SHIPPED.regulator_rules))
    assert found == ["내부회계", "ESG", "K-IFRS", "세법", None, None]


def test_summary_of_official_and_other_items(spark):
    rows = [
        ("법인세법 (일부개정) · 2027-01-01 시행", "세법", "법제처", True),
        ("감독지침 안내", "ESG", "금융위원회", True),
        ("법인세 뉴스", "세법", "한국경제", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string, s string, o boolean")
    args = (F.col("t"), F.col("c"), F.col("s"), F.col("o"), SHIPPED)
    found = df.select("i", summary.summary_lines(*args).alias("l"), summary.page_summary(*args).alias("p")).orderBy("i").collect()
    assert found[0].l == [
        "「법인세법」 관련 세법 규정이 일부개정되었습니다.",
        "2027-01-01부터 시행되며, 시행 전 실무 반영 여부를 확인해야 합니다.",
    ]
    assert found[1].l[0] == "「감독지침 안내」 관련 ESG 규정이 개정되었습니다."
    assert found[1].l[1].startswith("공식 원문을 통해")
    assert found[2].l[0] == "한국경제가 보도한 세법 분야 동향입니다."
    assert "2027-01-01부터 시행됩니다." in found[0].p
    assert found[2].p.startswith("한국경제의 세법 관련 보도입니다.")


def test_impact_uses_code_points_and_the_default_category(column):
    values = ["가나다", "😀title beyond ten characters", "", "ab"]
    templates = SHIPPED.impact["세법"]
    expected = [templates[sum(map(ord, v[:10])) % 3] for v in values]
    for category in ("세법", "모르는 분야"):
        assert column(values, lambda c: summary.impact_pick(c, F.lit(category), SHIPPED)) == expected
