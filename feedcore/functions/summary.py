"""Rule-based summaries: two lines and an impact sentence per item."""

from __future__ import annotations

from functools import reduce
from operator import add
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedcore.functions.dates import effective_date_text
from feedcore.functions.text import let, short_name
from feedcore.rules import RuleBook

# How much of a title seeds the choice of an impact sentence.
SEED_LENGTH = 10


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def amendment_kind(title: Column, rules: RuleBook) -> Column:
    """First amendment word in the title, else the general word."""
    words = "|".join(rules.wording.amendment_kinds)
    found = F.regexp_extract(title, f"({words})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(rules.wording.default_kind))


def fill(template: str, **values: Column) -> Column:
    """A sentence with columns in its ``{...}`` places."""
    parts = []
    for fixed, name, _, _ in Formatter().parse(template):
        if fixed:
            parts.append(F.lit(fixed))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def _when_dated(title: Column, dated: str, otherwise: str) -> Column:
    """``dated`` with the title's effective date in it, or ``otherwise`` if it has none."""
    return let(
        effective_date_text(title),
        lambda date: F.when(date != "", fill(dated, date=date)).otherwise(F.lit(otherwise)),
    )


def summary_lines(
    title: Column, category: Column, source: Column, official: Column, rules: RuleBook
) -> Column:
    """Two sentences: about the rule for official items, about the outlet for others."""
    w = rules.wording
    title, category, source = _text(title), _text(category), _text(source)
    kind = amendment_kind(title, rules)
    official_lines = F.array(
        fill(w.official_first, name=short_name(title), category=category, kind=kind),
        _when_dated(title, w.official_dated, w.official_undated),
    )
    other_lines = F.array(
        fill(w.other_first, source=source, category=category), F.lit(w.other_second)
    )
    return F.when(official, official_lines).otherwise(other_lines)


def page_summary(
    title: Column, category: Column, source: Column, official: Column, rules: RuleBook
) -> Column:
    """The one-paragraph wording shown when browsing."""
    w = rules.wording
    title, category, source = _text(title), _text(category), _text(source)
    about = fill(w.page_official, name=short_name(title), category=category)
    official_text = F.concat(
        about, _when_dated(title, w.page_effective, ""), F.lit(w.page_official_end)
    )
    return F.when(official, official_text).otherwise(
        fill(w.page_other, source=source, category=category)
    )


def title_seed(title: Column) -> Column:
    """Sum of the code points of the title's first characters."""
    points = [F.ascii(F.substring(_text(title), i, 1)) for i in range(1, SEED_LENGTH + 1)]
    return reduce(add, points)


def impact_pick(title: Column, category: Column, rules: RuleBook) -> Column:
    """One of the category's sentences, chosen by the title; unknown categories use the default's."""

    def choose(templates: tuple[str, ...]) -> Column:
        sentences = F.array(*[F.lit(t) for t in templates])
        return F.get(sentences, title_seed(title) % len(templates))

    result = choose(rules.impact[rules.impact_default])
    for name, templates in rules.impact.items():
        if name != rules.impact_default:
            result = F.when(category == name, choose(templates)).otherwise(result)
    return result
