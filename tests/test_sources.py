"""Each reader on literal payloads with the shipped rules."""

import pytest
from pyspark.sql import functions as F

from feedcore.plans.ingest import ingest, request_outcomes
from feedcore.rules import SHIPPED, SHIPPED_V1
from feedcore.schema import ITEM_COLUMNS, RAW, conform
from feedcore.sources import payload, readers, scan

AS_OF = "2026-08-08"


def raw(spark, *rows):
    """Rows of (source, category, query, body[, attempt, ok[, request]])."""
    full = []
    for i, row in enumerate(rows):
        source, category, query, body, attempt, ok, request = (*row, *(0, True, f"r{i}")[len(row) - 4 :])
        full.append((f"p{i:03}", request, source, category, query, attempt, ok, body))
    schema = (
        "payload_id string, request_id string, source string, category string, query string, "
        "attempt_rank int, status_ok boolean, body string"
    )
    return conform(spark.createDataFrame(full, schema), RAW)


def rss(*items):
    inner = "".join(
        f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate></item>" for t, u, d in items
    )
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>f</title>{inner}</channel></rss>'


def shown(df, *columns):
    return [tuple(r) for r in df.orderBy("payload_id", "feed_pos").select(*columns).collect()]


def test_regulator_feed(spark):
    body = rss(
        ("내부회계 &amp;amp; 감사\n  기준", " https://fsc/1 ", "Fri, 07 Aug 2026 23:30:00 +0900"),
        ("채용 회계 안내", "https://fsc/2", ""),
        ("관련 없는 소식", "https://fsc/3", ""),
        ("회계처리 지침", "", ""),
        ("<![CDATA[K-IFRS <b>개정]]>", "https://fsc/5", "2026.8.1"),
    )
    df = ingest(raw(spark, ("regulator_rss", None, None, body)), SHIPPED, AS_OF, 1)
    assert shown(df, "source", "source_type", "category", "title", "url", "date", "trust", "run_seq") == [
        ("금융위원회", "공식원문", "내부회계", "내부회계 & 감사 기준", "https://fsc/1", "2026-08-07", 100, 1),
        ("금융위원회", "공식원문", "K-IFRS", "K-IFRS <b>개정", "https://fsc/5", "2026-08-01", 100, 1),
    ]
    assert [o["label"] for o in df.first().official] == ["한국회계기준원", "금융위원회"]


def test_broken_and_odd_payloads_give_no_rows(spark):
    bodies = [None, "", "not xml at all", "<rss><channel><item><title>회계", "<rss><channel></channel></rss>"]
    df = ingest(raw(spark, *[("regulator_rss", None, None, b) for b in bodies]), SHIPPED, AS_OF, 1)
    assert df.count() == 0


def test_items_below_the_root(spark):
    body = "<rdf><item><title>회계 소식</title><link>u</link></item></rdf>"
    df = ingest(raw(spark, ("regulator_rss", None, None, body)), SHIPPED, AS_OF, 1)
    assert shown(df, "title", "date") == [("회계 소식", AS_OF)]


LAWS = """<LawSearch><law id="1"><법령명한글>법인세법</법령명한글><공포일자>20260630</공포일자><시행일자>20270101</시행일자>
<제개정구분명>일부개정</제개정구분명><법령상세링크>/DRF/1</법령상세링크></law>
<law><법령명한글> </법령명한글><법령명>법인세법 시행령</법령명><공포일자></공포일자><시행일자>2027. 01. 01</시행일자><법령상세링크>http://x/2</법령상세링크></law>
<law><법령명한글>소득세법</법령명한글></law>
<law><법령명한글>법인 세법</법령명한글></law></LawSearch>"""


def test_laws(spark):
    again = LAWS.replace("/DRF/1", "/DRF/later")
    rows = raw(
        spark,
        ("law_registry", "세법", "법인세법", LAWS),
        ("law_registry", "세법", "조세특례제한법", again),
        ("law_registry", "K-IFRS", "주식회사 등의 외부감사에 관한 법률",
         "<LawSearch><law><법령명>주식회사등의외부감사에관한법률 시행령</법령명></law></LawSearch>"),
        ("law_registry", "ESG", "없는 요청", LAWS),
    )
    assert shown(ingest(rows, SHIPPED, AS_OF, 1), "category", "title", "url", "date") == [
        ("세법", "법인세법 (일부개정) · 2027-01-01 시행", "https://www.law.go.kr/DRF/1", "2026-06-30"),
        ("세법", "법인세법 시행령 · 2027-01-01 시행", "http://x/2", "2027-01-01"),
        ("세법", "법인 세법", "https://www.law.go.kr/법령/법인 세법", AS_OF),
        ("K-IFRS", "주식회사등의외부감사에관한법률 시행령",
         "https://www.law.go.kr/법령/주식회사등의외부감사에관한법률 시행령", AS_OF),
    ]


def test_first_category_keeps_a_law_found_twice(spark):
    rules = SHIPPED.replace(law_groups={"A": ("법인세법",), "B": ("세법",)})
    rows = raw(spark, ("law_registry", "B", "세법", LAWS), ("law_registry", "A", "법인세법", LAWS))
    found = readers.law_registry(payload.best_attempts(rows), rules, AS_OF)
    assert sorted(shown(found, "category", "title")) == sorted([
        ("A", "법인세법 (일부개정) · 2027-01-01 시행"), ("A", "법인세법 시행령 · 2027-01-01 시행"),
        ("A", "법인 세법"), ("B", "소득세법"),
    ])


def test_search_news(spark):
    items = [
        ("세법 개정안 발표 - 한국경제", "https://news.google.com/rss/1", "Fri, 07 Aug 2026 15:30:00 GMT"),
        ("세법 개정 - 수혜주 - 블로그", "u2", ""),
        ("세법 소식 - 매일", "u3", ""),
        ("소득세 예규 - 네이버 블로그", "u4", ""),
        ("국세청 세무조사", "https://www.mk.co.kr/5", "bad date"),
    ]
    df = ingest(raw(spark, ("search_news", "세법", "q", rss(*items))), SHIPPED, AS_OF, 1)
    assert shown(df, "source", "source_type", "title", "date", "trust") == [
        ("한국경제", "뉴스", "세법 개정안 발표", "2026-08-07", 30),
        ("매일경제", "뉴스", "국세청 세무조사", AS_OF, 60),
    ]


def test_news_caps_count_accepted_rows_per_answer(spark):
    items = [(f"{'주가' if i % 2 else '세법 개정'} {i} - 신문", f"u{i}", "") for i in range(40)]
    one = ("search_news", "세법", "q", rss(*items))
    df = ingest(raw(spark, one, one), SHIPPED, AS_OF, 1)
    kept = shown(df, "payload_id", "feed_pos")
    assert kept == [(p, 2 * i) for p in ("p000", "p001") for i in range(10)]


NEWS = (
    '{"items":[{"title":"<b>ESG 공시<\\/b> &quot;소식&quot;","originallink":"https://www.sedaily.com/1","link":"p1",'
    '"pubDate":"Fri, 07 Aug 2026 01:00:00 +0900"},{"title":"ESG공시 의무화","originallink":"","link":"https://n.x/2"},'
    '{"title":"KSSB 광고","link":"u"},{"title":"KSSB","originallink":"","link":""},{"title":"무관","link":"u"}]}'
)


def test_portal_news(spark):
    df = ingest(raw(spark, ("portal_news", "ESG", "q", NEWS), ("portal_news", "ESG", "q", NEWS[:50])), SHIPPED, AS_OF, 1)
    assert shown(df, "source", "title", "url", "date", "trust") == [
        ("서울경제", 'ESG 공시 "소식"', "https://www.sedaily.com/1", "2026-08-07", 60),
        ("네이버뉴스", "ESG공시 의무화", "https://n.x/2", AS_OF, 30),
    ]


def test_older_policies(spark):
    body = rss(("아무 소식 - 어떤 신문", "https://www.mk.co.kr/1", ""), ("주가 급등 - 신문", "u", ""), ("행사 할인 - 신문", "u", ""))
    found = readers.search_news(
        raw(spark, ("search_news", "세법", "q", body)).withColumn("body", F.col("body")),
        SHIPPED_V1, AS_OF, readers.SEARCH_POLICY_V1,
    )
    assert shown(found, "source", "source_type", "title", "trust") == [
        ("어떤 신문", "구글뉴스", "아무 소식", None), ("신문", "구글뉴스", "주가 급등", None),
    ]
    found = readers.portal_news(
        raw(spark, ("portal_news", "ESG", "q", NEWS)), SHIPPED_V1, AS_OF, readers.PORTAL_POLICY_V1
    )
    assert shown(found, "source", "source_type")[:2] == [("sedaily", "네이버뉴스"), ("n", "네이버뉴스")]


BOARD = """<html><table><thead><tr><th><a href="/h">머리</a></th></tr></thead><tbody>
<tr><td>1</td><td><a href="javascript:view('12345')"> 세법 <b>해설</b> </a></td><td>2026.8.7</td></tr>
<!-- <tr><td><a href="/no">숨김</a></td></tr> -->
<tr><td>no link</td></tr>
<tr><td><a href="/a/b?x=1&amp;y=2">둘째 글입니다</a> <a href="/other">덤</a></td><td>2026-13-45</td></tr>
<tr><td><a href="https://o/1">밖</a></td></tr>
<tr><td><a>주소 없음입니다</a></td></tr></tbody></table></html>"""


def board_rows(spark, source):
    spec = next(s for s in readers.OPTIONAL if s.name == source)
    rows = raw(spark, (source, None, "1005", BOARD))
    return shown(spec.read(rows, SHIPPED, AS_OF), "title", "url", "date")


def test_tax_board(spark):
    view = "https://www.nts.go.kr/nts/na/ntt/selectNttInfo.do?mi=2201&bbsId=1030&nttSn="
    assert board_rows(spark, "tax_board") == [
        ("세법해설", view + "12345", "2026-08-07"),
        ("둘째 글입니다", "https://www.nts.go.kr/a/b?x=1&y=2", "2026-13-45"),
        ("밖", "https://o/1", AS_OF),
        ("주소 없음입니다", "https://www.nts.go.kr", AS_OF),
    ]


def test_standards_board(spark):
    base = "https://www.kasb.or.kr"
    assert board_rows(spark, "standards_board") == [
        ("세법해설", base + "/fe/bbs/NR_view.do?bbsCd=1005&bbsSeq=12345", "2026-08-07"),
        ("둘째 글입니다", base + "/a/b?x=1&y=2", "2026-13-45"),
        ("주소 없음입니다", base + "/fe/bbs/NR_list.do?bbsCd=1005", AS_OF),
    ]


def test_supervisor_anchors(spark):
    links = "".join(f'<a href="/v/{i}">회계감독 소식 {i}</a>' for i in range(30))
    page = f'<script>var a="<a href=x>회계 아님 아님</a>"</script><a href="#">짧은회계</a><a href="/x">인사 회계 소식</a>{links}'
    spec = next(s for s in readers.OPTIONAL if s.name == "supervisor_anchors")
    found = shown(spec.read(raw(spark, ("supervisor_anchors", None, None, page)), SHIPPED, AS_OF), "title", "url", "category")
    assert found == [(f"회계감독 소식 {i}", f"https://www.fss.or.kr/v/{i}", "회계기준") for i in range(20)]


def test_optional_sources_are_filled_in_or_left_open(spark):
    rows = raw(
        spark,
        ("ministry_rss", None, None, rss((" 세법 개정 ", "", "2026-08-01 10:00:00"), ("다른 일", "u", ""))),
        ("briefing_rss", None, None, rss(("시행령 일부개정", "https://k/1", ""), ("정례브리핑 세법", "u", ""))),
        ("mixed_rss", None, None, rss(("감독규정 개정", "https://f/1", ""),)),
    )
    filled = ingest(rows, SHIPPED, AS_OF, 1, readers.OPTIONAL)
    assert shown(filled, "source", "source_type", "category", "title", "url", "trust") == [
        ("기획재정부", "뉴스", "세법", "세법 개정", "", 30),
        ("정책브리핑", "뉴스", "세법", "시행령 일부개정", "https://k/1", 30),
        ("금융위원회", "공식원문", "세법", "감독규정 개정", "https://f/1", 100),
    ]
    assert filled.where("size(official) = 2").count() == 3
    left = ingest(rows, SHIPPED, AS_OF, 1, readers.OPTIONAL, strict_reference=True)
    assert shown(left, "source_type", "category", "trust") == [
        (None, "세법", None), (None, "법령", None), (None, "법령", None),
    ]


LONG = rss(("회계 소식입니다", "https://long/1", "2026-08-01"))
ATTEMPTS = [
    # request, attempt, ok, body -> used attempt
    ("first", 0, True, "short"), ("first", 1, True, LONG),
    ("second", 0, False, LONG), ("second", 1, True, LONG), ("second", 2, True, LONG),
    ("third", 0, False, LONG), ("third", 1, True, "x" * 200), ("third", 2, True, LONG),
    ("none", 0, False, LONG), ("none", 1, True, "<rss>"), ("none", 2, None, LONG),
    ("empty", 0, True, ""), ("empty", 1, True, LONG),
    ("alone", 0, True, LONG),
]


@pytest.mark.parametrize("max_broadcast", [100, 2, 0])
def test_best_attempt(spark, max_broadcast):
    rows = raw(spark, *[("regulator_rss", None, None, body, n, ok, r) for r, n, ok, body in ATTEMPTS])
    found = payload.best_attempts(rows, True, payload.contested_requests(rows, max_broadcast))
    assert sorted((r.request_id, r.attempt_rank) for r in found.collect()) == [
        ("alone", 0), ("empty", 0), ("first", 0), ("second", 1), ("third", 2),
    ]


@pytest.mark.parametrize("max_broadcast", [100, 0])
def test_attempts_without_a_request_stand_alone(spark, max_broadcast):
    rows = raw(spark, *[("regulator_rss", None, None, LONG, 0, True, r) for r in ("a", "a", None, None, None)])
    found = payload.best_attempts(rows, True, payload.contested_requests(rows, max_broadcast))
    assert sorted(str(r.request_id) for r in found.collect()) == ["None", "None", "None", "a"]


def test_feed_items_of_all_channels_and_the_root(spark):
    entry = "<item><title>{0}</title><title>no</title><link>u{0}</link></item>"
    a, b, c = (entry.format(n) for n in "abc")
    bodies = [f"<rss><channel>{a}</channel><channel>{b}</channel>{c}</rss>", f"<rss>{c}</rss>", "<rss><channel/></rss>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bodies)], "id int, body string")
    found = scan.rss_entries(df).orderBy("id", "feed_pos").collect()
    assert [(r.id, r.raw_title, r.raw_link) for r in found] == [(0, "a", "ua"), (0, "b", "ub"), (0, "c", "uc"), (1, "c", "uc")]


def test_an_unclosed_anchor_ends_at_the_next(spark):
    df = spark.createDataFrame([('<a href="/1">first<p><a href="/2">second</a><a href="/3">third',)], "body string")
    found = [(r.raw_link, r.raw_title) for r in scan.anchor_entries(df).orderBy("feed_pos").collect()]
    assert found == [("/1", "first"), ("/2", "second"), ("/3", "third")]


def test_gate_counts_bytes(spark):
    df = spark.createDataFrame([("가" * 33,), ("가" * 33 + "x",), (None,), ("<item" + "x" * 95,)], "body string")
    found = df.select(payload.looks_ok(F.col("body"), False).alias("a"), payload.looks_ok(F.col("body")).alias("b"))
    assert [tuple(r) for r in found.collect()] == [(False, False), (True, False), (False, False), (True, True)]


def test_outcomes(spark):
    rows = raw(
        spark,
        *[("regulator_rss", None, None, body, n, ok, r) for r, n, ok, body in ATTEMPTS],
        ("portal_news", "ESG", "q", NEWS[:60], 0, True, "cut"),
        ("portal_news", "ESG", "q", NEWS, 0, True, "good"),
        ("law_registry", "세법", "q", "<LawSearch><law>", 0, True, "cutlaw"),
    )
    found = {r.request_id: r.failure for r in request_outcomes(rows).collect()}
    assert found == {
        "first": "broken payload", "second": None, "third": None, "none": "no answer", "empty": None,
        "alone": None, "cut": "broken payload", "good": None, "cutlaw": "broken payload",
    }


def test_items_have_all_columns(spark):
    df = ingest(raw(spark, ("regulator_rss", None, None, LONG)), SHIPPED, AS_OF, 1)
    assert set(ITEM_COLUMNS) <= set(df.columns)
