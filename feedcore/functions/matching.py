"""Keyword predicates and classification as generated code.

Keyword lists become ``contains(a) OR contains(b) OR ...`` and ordered rules a
``CASE WHEN``: both stay inside whole-stage code generation, stop at the first
hit, and need neither join nor shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedcore.rules import CategoryRule, KeywordRule, RuleBook


def any_contains(text: Column, keywords: Iterable[str]) -> Column:
    """True if the text contains one of the keywords; case matters.

    Null text gives null, which every filter here drops; a bare disjunction can
    be pushed down to the file scan.
    """
    tests: Sequence[Column] = [text.contains(k) for k in keywords]
    if not tests:
        return F.lit(False)
    while len(tests) > 1:  # a balanced tree: long lists must not nest deeply
        tests = [reduce(or_, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def is_noise(title: Column, rules: RuleBook) -> Column:
    return any_contains(title, rules.noise)


def is_ad(title: Column, rules: RuleBook, outlet: Column | None = None) -> Column:
    """Advertising words in the title, or a low-quality outlet."""
    in_title = any_contains(title, rules.ads)
    if outlet is None:
        return in_title
    return in_title | any_contains(F.coalesce(outlet, F.lit("")), rules.low_quality_sources)


def should_exclude(title: Column, rules: RuleBook, outlet: Column | None = None) -> Column:
    return is_noise(title, rules) | is_ad(title, rules, outlet)


def _fits(title: Column, rule: CategoryRule, strict: bool) -> Column:
    has_must = any_contains(title, rule.must)
    return has_must & any_contains(title, rule.combine) if strict else has_must


def _match(title: Column, category: Column, rules: RuleBook, strict: bool) -> Column:
    result = F.lit(False)
    for rule in reversed(rules.categories):
        result = F.when(category == rule.category, _fits(title, rule, strict)).otherwise(result)
    return result


def match_strict(title: Column, category: Column, rules: RuleBook) -> Column:
    """One must word and one combine word of the row's own category."""
    return _match(title, category, rules, strict=True)


def match_loose(title: Column, category: Column, rules: RuleBook) -> Column:
    """One must word of the row's own category."""
    return _match(title, category, rules, strict=False)


def classify_ordered(title: Column, ordered: Sequence[KeywordRule]) -> Column:
    """Category of the first rule with a keyword in the title, else null."""
    result = F.lit(None).cast("string")
    for rule in reversed(ordered):
        result = F.when(any_contains(title, rule.keywords), F.lit(rule.category)).otherwise(result)
    return result


def classify_strict(title: Column, rules: RuleBook) -> Column:
    """First category, in definition order, that the title matches strictly."""
    result = F.lit(None).cast("string")
    for rule in reversed(rules.categories):
        result = F.when(_fits(title, rule, True), F.lit(rule.category)).otherwise(result)
    return result


def is_official(source_type: Column, rules: RuleBook) -> Column:
    """The split used when merging: by ``source_type`` alone."""
    return F.coalesce(source_type == rules.official_type, F.lit(False))


def is_official_on_reload(source: Column, source_type: Column, rules: RuleBook) -> Column:
    """The wider test used on stored rows: official source or official type."""
    return F.coalesce(source.isin(*rules.official_sources), F.lit(False)) | is_official(
        source_type, rules
    )
