"""Rule tables: keywords, block lists, source trust, links, wording.

A ``RuleBook`` is a handful of small tables.  The one shipped here is the
Korean tax and accounting set; callers may replace any table, from Python or
from DataFrames (``replace_from_frames``).  Tables are read to the driver only
behind a row limit, because they end up as literals in the plan.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rule rows that still make a sensible literal expression.
MAX_LITERAL_RULES = 2_000


@dataclass(frozen=True)
class CategoryRule:
    """A title fits if it has one of ``must`` and, when strict, one of ``combine``."""

    category: str
    must: tuple[str, ...]
    combine: tuple[str, ...]


@dataclass(frozen=True)
class KeywordRule:
    category: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class TrustRule:
    fragment: str
    score: int
    name: str


@dataclass(frozen=True)
class Wording:
    """Sentences of the generated summaries; ``{...}`` marks where values go."""

    official_first: str
    official_dated: str
    official_undated: str
    other_first: str
    other_second: str
    amendment_kinds: tuple[str, ...]
    default_kind: str
    page_official: str
    page_effective: str
    page_official_end: str
    page_other: str


@dataclass(frozen=True)
class RuleBook:
    categories: tuple[CategoryRule, ...]
    noise: tuple[str, ...]
    ads: tuple[str, ...]
    low_quality_sources: tuple[str, ...]
    trust: tuple[TrustRule, ...]
    default_trust: int
    official_trust: int
    official_links: dict[str, tuple[tuple[str, str], ...]]
    impact: dict[str, tuple[str, ...]]
    impact_default: str
    migration: dict[str, str]
    allowed: tuple[str, ...]
    official_sources: tuple[str, ...]
    official_type: str
    news_type: str
    codes: dict[str, str]
    wording: Wording
    law_groups: dict[str, tuple[str, ...]]
    regulator_rules: tuple[KeywordRule, ...]
    regulator_exclude: tuple[str, ...]
    briefing_rules: tuple[KeywordRule, ...]
    briefing_exclude: tuple[str, ...]
    mixed_rules: tuple[KeywordRule, ...]
    mixed_exclude: tuple[str, ...]
    ministry_keywords: tuple[str, ...]
    keep_days: int
    # Entries kept of one payload; None keeps all.
    search_cap: int | None
    portal_cap: int | None
    anchor_cap: int | None

    def replace(self, **changes) -> RuleBook:
        return dataclasses.replace(self, **changes)


# ---------------------------------------------------------------------------
# The shipped rule set.  Word lists, scores, links and sentences
# are data that results depend on; they are stated here as they are.
# ---------------------------------------------------------------------------

TAX = "세법"
STANDARDS = "K-IFRS"
INTERNAL_CONTROL = "내부회계"
ESG = "ESG"

_STANDARDS_LINKS = (
    ("한국회계기준원", "https://www.kasb.or.kr/"),
    ("금융위원회", "https://www.fsc.go.kr/index"),
)

SHIPPED = RuleBook(
    categories=(
        CategoryRule(
            STANDARDS,
            ("K-IFRS", "회계기준", "회계기준원", "금융위원회", "회계감리"),
            (
                "개정", "제정", "공표", "MPM", "경영진성과측정치", "기준서", "주석 공시",
                "회계처리", "회계처리 지침", "감리", "감리 지적",
            ),
        ),
        CategoryRule(
            TAX,
            (
                "세법", "세제개편", "국세청", "유권해석", "기획재정부", "법인세",
                "부가가치세", "소득세", "조세",
            ),
            (
                "개정안", "시행령", "시행령 개정", "조세특례제한법", "부가가치세법",
                "법인세법", "소득세법", "지방세법", "국세기본법", "국제조세", "예규",
                "판례", "조세심판원", "세무조사", "개정",
            ),
        ),
        CategoryRule(
            ESG,
            ("ESG 공시", "ESG공시", "지속가능경영", "ISSB", "KSSB", "GRI"),
            (
                "의무화", "공시기준", "로드맵", "스코프3", "Scope 3", "Scope3",
                "공급망 실사", "글로벌 스탠다드", "가이드라인", "지속가능성",
            ),
        ),
        CategoryRule(
            INTERNAL_CONTROL,
            ("내부회계관리제도", "내부회계", "내부통제", "외감법"),
            (
                "감사 전환", "모범규준", "취약점", "외감법 개정", "연결 내부회계",
                "평가 가이드라인", "내부통제 미비점", "가이드라인", "감사",
            ),
        ),
    ),
    noise=(
        "테마주", "수혜주", "주가", "급등", "급락", "상한가", "하한가", "리포트 매수",
        "매수 추천", "특징주", "개미", "재테크", "비트코인", "가상자산 시세",
        "투자 유망", "유망주", "증시 일정", "코스피", "코스닥", "장마감", "시황",
        "선물옵션", "환율 전망", "목표주가", "투자의견", "술렁", "들썩", "매물", "호가",
        "집값", "전셋값", "청약 경쟁", "갭투자", "영끌", "부동산 투자", "재건축 기대",
        "분양가", "아파트값",
    ),
    ads=(
        "제휴", "광고", "분양", "이벤트", "할인", "쿠폰", "특가", "무료체험", "카드혜택",
        "적립", "사은품", "프로모션", "협찬", "[AD]", "(광고)", "바로가기", "무료상담",
        "가입혜택", "최저가", "핫딜",
    ),
    low_quality_sources=("뉴스와이어", "보도자료", "블로그", "카페"),
    trust=(
        TrustRule("kasb.or.kr", 100, "한국회계기준원"),
        TrustRule("fsc.go.kr", 100, "금융위원회"),
        TrustRule("law.go.kr", 100, "국가법령정보센터"),
        TrustRule("nts.go.kr", 100, "국세청"),
        TrustRule("mof.go.kr", 100, "기획재정부"),
        TrustRule("moef.go.kr", 100, "기획재정부"),
        TrustRule("fss.or.kr", 95, "금융감독원"),
        TrustRule("intn.co.kr", 80, "일간NTN"),
        TrustRule("taxtimes.co.kr", 80, "한국세정신문"),
        TrustRule("joseilbo.com", 80, "조세일보"),
        TrustRule("impacton.net", 80, "임팩트온"),
        TrustRule("esgeconomy.com", 80, "ESG경제"),
        TrustRule("cpanews", 80, "CPA뉴스"),
        TrustRule("pwc.com", 70, "PwC(삼일)"),
        TrustRule("kpmg.com", 70, "KPMG(삼정)"),
        TrustRule("ey.com", 70, "EY(한영)"),
        TrustRule("deloitte.com", 70, "Deloitte(안진)"),
        TrustRule("mk.co.kr", 60, "매일경제"),
        TrustRule("hankyung.com", 60, "한국경제"),
        TrustRule("sedaily.com", 60, "서울경제"),
        TrustRule("mt.co.kr", 60, "머니투데이"),
        TrustRule("edaily.co.kr", 60, "이데일리"),
        TrustRule("fnnews.com", 60, "파이낸셜뉴스"),
        TrustRule("yna.co.kr", 60, "연합뉴스"),
    ),
    default_trust=30,
    official_trust=100,
    official_links={
        STANDARDS: _STANDARDS_LINKS,
        TAX: (
            ("국가법령정보센터", "https://www.law.go.kr/"),
            ("국세청", "https://www.nts.go.kr/"),
        ),
        INTERNAL_CONTROL: _STANDARDS_LINKS,
        ESG: _STANDARDS_LINKS,
    },
    impact={
        TAX: (
            "세무조정·신고 실무에 반영이 필요하며, 시행일 전 관련 규정을 점검하세요.",
            "법인·소득 신고 시 개정 내용 적용 여부를 사전에 확인해야 합니다.",
            "세무팀은 개정 시행일 기준으로 내부 프로세스 업데이트를 검토하세요.",
        ),
        STANDARDS: (
            "회계정책 및 재무제표 표시에 영향이 있어 결산 전 영향분석이 필요합니다.",
            "감사 대응을 위해 기준서 변경 사항을 회계처리에 선반영하세요.",
            "재무보고 담당자는 공시 서식·주석 변경 여부를 확인해야 합니다.",
        ),
        INTERNAL_CONTROL: (
            "내부회계관리제도 운영·평가 절차에 반영이 필요합니다.",
            "감사 대응 및 미비점 개선 계획에 본 개정 사항을 포함하세요.",
            "내부통제 문서화·평가 일정에 영향이 있는지 점검이 필요합니다.",
        ),
        ESG: (
            "지속가능성 공시 대응 로드맵에 반영해 단계별 준비가 필요합니다.",
            "공급망·배출량 데이터 수집 체계를 사전에 점검하세요.",
            "공시 의무화 일정에 맞춰 내부 데이터 관리 체계를 준비해야 합니다.",
        ),
    },
    impact_default=TAX,
    migration={"회계기준": STANDARDS, "법령": TAX},
    allowed=(TAX, STANDARDS, INTERNAL_CONTROL, ESG),
    official_sources=("법제처", "금융위원회"),
    official_type="공식원문",
    news_type="뉴스",
    codes={TAX: "tax", STANDARDS: "ifrs", INTERNAL_CONTROL: "icfr", ESG: "esg"},
    wording=Wording(
        official_first="「{name}」 관련 {category} 규정이 {kind}되었습니다.",
        official_dated="{date}부터 시행되며, 시행 전 실무 반영 여부를 확인해야 합니다.",
        official_undated="공식 원문을 통해 세부 개정 내용과 적용 시점을 확인하세요.",
        other_first="{source}가 보도한 {category} 분야 동향입니다.",
        other_second="관련 기관 공식 자료와 함께 실무 적용 사항을 검토할 필요가 있습니다.",
        amendment_kinds=("일부개정", "전부개정", "타법개정", "제정"),
        default_kind="개정",
        page_official="「{name}」 관련 {category} 개정 사항입니다.",
        page_effective=" {date}부터 시행됩니다.",
        page_official_end=" 아래 공식 원문에서 상세 내용을 확인하세요.",
        page_other=(
            "{source}의 {category} 관련 보도입니다. "
            "기사 원문과 함께, 관련 기관 공식 자료를 나란히 확인할 수 있습니다."
        ),
    ),
    law_groups={
        TAX: (
            "법인세법", "소득세법", "부가가치세법", "국세기본법", "국세징수법",
            "상속세 및 증여세법", "종합부동산세법", "조세특례제한법", "관세법",
        ),
        STANDARDS: ("주식회사 등의 외부감사에 관한 법률",),
        INTERNAL_CONTROL: (),
        ESG: (),
    },
    regulator_rules=(
        KeywordRule(INTERNAL_CONTROL, ("내부회계", "내부통제", "내부회계관리제도")),
        KeywordRule(ESG, ("지속가능성", "ESG", "기후", "지속가능경영", "탄소")),
        KeywordRule(
            STANDARDS,
            (
                "회계기준", "회계처리", "외부감사", "감사인", "재무제표", "IFRS", "K-IFRS",
                "회계감독", "공시서식", "사업보고서", "감사보고서", "회계",
            ),
        ),
        KeywordRule(
            TAX,
            (
                "세제", "세법", "과세", "비과세", "세액공제", "증권거래세", "금융세제",
                "양도소득세", "배당소득",
            ),
        ),
    ),
    regulator_exclude=(
        "채용", "인사", "포상", "공모", "세미나", "간담회", "행사", "정부포상", "후보자",
        "부고", "일정", "안내", "briefing",
    ),
    briefing_rules=(
        KeywordRule(
            "회계기준",
            (
                "회계기준", "K-IFRS", "IFRS", "회계처리", "외부감사", "감사기준", "재무제표",
                "회계감독", "지속가능성 공시", "ESG 공시",
            ),
        ),
        KeywordRule(
            TAX,
            (
                "세법", "법인세", "소득세", "부가가치세", "종합부동산세", "종부세", "상속세",
                "증여세", "조세", "관세", "세제", "세액", "과세", "비과세", "납세", "세율",
                "세금", "세무", "연말정산", "원천징수",
            ),
        ),
        KeywordRule(
            "법령",
            (
                "시행령", "시행규칙", "일부개정", "전부개정", "제정령", "입법예고", "법률안",
                "주요 시행법령", "공포",
            ),
        ),
    ),
    briefing_exclude=("채용", "인사발령", "정례브리핑", "일일 정례"),
    mixed_rules=(
        KeywordRule(
            "회계기준",
            (
                "회계", "감사", "외부감사", "공시", "재무제표", "IFRS", "회계기준",
                "내부회계", "지속가능성", "ESG",
            ),
        ),
        KeywordRule(
            "법령",
            (
                "개정", "제정", "규정", "고시", "입법예고", "규정변경예고", "시행",
                "감독규정", "제도",
            ),
        ),
    ),
    mixed_exclude=(
        "채용", "인사", "포상", "공모", "세미나", "간담회 참가", "행사 개최", "정부포상",
        "후보자", "일정", "부고",
    ),
    ministry_keywords=(
        "세법", "개정", "법인세", "소득세", "부가가치세", "조세", "시행령", "시행규칙",
    ),
    keep_days=180,
    search_cap=10,
    portal_cap=8,
    anchor_cap=20,
)

#: The older behaviour: one tax link, caps of 8 and 6 (with ``SEARCH_POLICY_V1`` and ``PORTAL_POLICY_V1`` of the readers).
SHIPPED_V1 = SHIPPED.replace(
    official_links={
        **SHIPPED.official_links,
        TAX: (("국가법령정보센터", "https://www.law.go.kr/"),),
    },
    search_cap=8,
    portal_cap=6,
)


def _bounded_rows(df: DataFrame, name: str) -> list[Row]:
    rows = df.limit(MAX_LITERAL_RULES + 1).collect()
    if len(rows) > MAX_LITERAL_RULES:
        raise ValueError(
            f"rule table {name} has more than {MAX_LITERAL_RULES} rows; "
            "use the join form of the operator instead"
        )
    return rows


def replace_from_frames(rules: RuleBook, frames: dict[str, DataFrame]) -> RuleBook:
    """Replace tables of a rule book by DataFrames of the same shape.

    ``categories(category, prio, must, combine)``, ``ordered(rule_set, prio,
    category, keywords)``, ``blocklist(list_name, keyword)``, ``trust(prio,
    fragment, score, name)``, ``official_links(category, pos, label, url)``,
    ``impact(category, templates)``, ``law_groups(category, law, prio)``,
    ``migration(old, new)``.
    """
    changes: dict = {}
    if "categories" in frames:
        rows = _bounded_rows(frames["categories"].orderBy("prio"), "categories")
        changes["categories"] = tuple(
            CategoryRule(r.category, tuple(r.must), tuple(r.combine)) for r in rows
        )
    if "ordered" in frames:
        sets: dict[str, list[KeywordRule]] = {}
        for r in _bounded_rows(frames["ordered"].orderBy("rule_set", "prio"), "ordered"):
            sets.setdefault(r.rule_set, []).append(KeywordRule(r.category, tuple(r.keywords)))
        changes.update({name: tuple(found) for name, found in sets.items()})
    if "blocklist" in frames:
        lists: dict[str, list[str]] = {}
        for r in _bounded_rows(frames["blocklist"], "blocklist"):
            lists.setdefault(r.list_name, []).append(r.keyword)
        changes.update({name: tuple(words) for name, words in lists.items()})
    if "trust" in frames:
        rows = _bounded_rows(frames["trust"].orderBy("prio"), "trust")
        changes["trust"] = tuple(TrustRule(r.fragment, r.score, r.name) for r in rows)
    if "official_links" in frames:
        links: dict[str, list[tuple[str, str]]] = {}
        for r in _bounded_rows(frames["official_links"].orderBy("category", "pos"), "official_links"):
            links.setdefault(r.category, []).append((r.label, r.url))
        changes["official_links"] = {c: tuple(found) for c, found in links.items()}
    if "impact" in frames:
        rows = _bounded_rows(frames["impact"], "impact")
        changes["impact"] = {r.category: tuple(r.templates) for r in rows}
    if "law_groups" in frames:
        groups: dict[str, list[str]] = {}
        for r in _bounded_rows(frames["law_groups"].orderBy("prio"), "law_groups"):
            groups.setdefault(r.category, []).append(r.law)
        changes["law_groups"] = {c: tuple(found) for c, found in groups.items()}
    if "migration" in frames:
        rows = _bounded_rows(frames["migration"], "migration")
        changes["migration"] = {r.old: r.new for r in rows}
    return rules.replace(**changes)


def trust_frame(spark: SparkSession, rules: RuleBook) -> DataFrame:
    """The trust table as a DataFrame, for the join form."""
    rows = [(i, t.fragment, t.score, t.name) for i, t in enumerate(rules.trust)]
    return spark.createDataFrame(rows, "prio int, fragment string, score int, name string")


def links_frame(spark: SparkSession, rules: RuleBook) -> DataFrame:
    rows = [
        (category, pos, label, url)
        for category, links in rules.official_links.items()
        for pos, (label, url) in enumerate(links)
    ]
    return spark.createDataFrame(rows, "category string, pos int, label string, url string")


def law_group_frame(spark: SparkSession, rules: RuleBook) -> DataFrame:
    """Requested laws with their order; empty groups give no row."""
    pairs = [(category, law) for category, laws in rules.law_groups.items() for law in laws]
    rows = [(category, law, i) for i, (category, law) in enumerate(pairs)]
    return spark.createDataFrame(rows, "category string, law string, group_rank int")


def string_map(table: dict[str, str]):
    """A small dict as a literal map column."""
    if len(table) > MAX_LITERAL_RULES:
        raise ValueError("table too large for a literal map")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
