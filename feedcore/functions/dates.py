"""Publication dates, compact dates, effective dates and month arithmetic.

A publication date is the wall date in the feed's own offset.  Parsing to an
instant would move late-evening and early-morning rows to another day, so the
day, month and year are taken from the text and checked by ``try_cast``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedcore.functions.text import SPACE_CHARACTERS, SPACES, let, strip

_DAY_NAMES = "mon|tue|wed|thu|fri|sat|sun"
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_CLOCK = r"(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]"
_OFFSET = r"(?:[+-][0-9]{2}:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?|(?-i:Z))"
_ZONE_NAMES = ("UTC", "GMT")

DASH_DOT = "[-.]"
DASH_DOT_SLASH = r"[.\-/]"


def day(value: dt.date | str) -> Column:
    """A run date given by the caller, as a date column."""
    return F.lit(str(value)).cast("date")


def day_text(value: dt.date | str) -> Column:
    return F.date_format(day(value), "yyyy-MM-dd")


def _mail_date(text: Column, zone: str) -> Column:
    """``Fri, 07 Aug 2026 23:30:00 +0900`` to ``2026-08-07``; null if it is not one."""
    pattern = (
        rf"(?i)^(?:{_DAY_NAMES}),{SPACES}([0-9]{{1,2}}){SPACES}({_MONTHS}){SPACES}([0-9]{{4}})"
        rf"{SPACES}{_CLOCK}{SPACES}{zone}\z"
    )
    names = F.lit(_MONTHS.replace("|", ""))

    def written(packed: Column) -> Column:  # 2026Aug7
        month = F.floor((F.instr(names, F.lower(F.substring(packed, 5, 3))) + 2) / 3)
        date = F.concat_ws(
            "-", F.substring(packed, 1, 4), month.cast("string"), F.substring(packed, 8, 2)
        )
        return date.try_cast("date").cast("string")

    # A text that is no mail date comes back from the replacement unchanged.
    return let(
        F.regexp_replace(text, pattern, "$3$2$1"), lambda p: F.when(p != text, written(p))
    )


_ZONES = f"(?:{'|'.join(_ZONE_NAMES)})"
_OFFSET_OR_ZONE = f"(?:{_OFFSET}|{_ZONES})"


def numeric_date(text: Column, separators: str) -> Column:
    """First ``year sep month sep day`` anywhere in the text, zero padded.

    There is no range check: ``2026-13-45`` stays as it is.
    """
    found = F.regexp_extract(text, f"[0-9]{{4}}{separators}[0-9]{{1,2}}{separators}[0-9]{{1,2}}", 0)

    def padded(date: Column) -> Column:
        year, month, day_number = (F.split_part(date, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
        return F.when(
            date != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day_number, 2, "0"))
        )

    return let(F.translate(found, "./", "--"), padded)


def _parsed(text: Column, as_of: dt.date | str, *forms) -> Column:
    """First form that reads the text, else ``as_of``."""
    tidy = strip(F.coalesce(text, F.lit("")))
    return F.coalesce(let(tidy, lambda t: F.coalesce(*[form(t) for form in forms])), day_text(as_of))


def press_release_date(text: Column, as_of: dt.date | str) -> Column:
    """Mail date with offset or zone name, else a date in the text, else ``as_of``.

    The briefing feed tries the zone name first; as a text cannot have both, one
    pattern serves either order.
    """
    return _parsed(
        text, as_of, lambda t: _mail_date(t, _OFFSET_OR_ZONE), lambda t: numeric_date(t, DASH_DOT)
    )


def search_feed_date(text: Column, as_of: dt.date | str) -> Column:
    """Mail date with zone name or offset, else ``as_of``."""
    return _parsed(text, as_of, lambda t: _mail_date(t, _OFFSET_OR_ZONE))


def news_api_date(text: Column, as_of: dt.date | str) -> Column:
    """Mail date with offset, else ``as_of``."""
    return _parsed(text, as_of, lambda t: _mail_date(t, _OFFSET))


def ministry_date(text: Column, as_of: dt.date | str) -> Column:
    """Mail date with offset, else ISO date or date-time, else any date, else ``as_of``.

    An ISO text has its date where the general search finds it first, so one
    expression serves both.
    """
    return _parsed(
        text, as_of, lambda t: _mail_date(t, _OFFSET), lambda t: numeric_date(t, DASH_DOT_SLASH)
    )


def board_date(row_text: Column, as_of: dt.date | str) -> Column:
    """A date somewhere in a board row, else ``as_of``."""
    return _parsed(row_text, as_of, lambda t: numeric_date(t, DASH_DOT_SLASH))


def compact_date(text: Column) -> Column:
    """``20260630`` or ``2026. 06. 30`` to ``2026-06-30``; other text comes back squeezed."""
    # Without a replacement, translate drops the listed characters.
    squeezed = F.translate(F.coalesce(text, F.lit("")), ".-" + SPACE_CHARACTERS, "")

    def dashed(t: Column) -> Column:
        parts = (F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
        return F.when(t.rlike(r"^[0-9]{8}\z"), F.concat_ws("-", *parts)).otherwise(t)

    return let(squeezed, dashed)


def choose_date(published: Column, effective: Column, as_of: dt.date | str) -> Column:
    return F.coalesce(
        F.nullif(published, F.lit("")), F.nullif(effective, F.lit("")), day_text(as_of)
    )


# The word after an effective date.
EFFECTIVE_WORD = "시행"


def effective_date_text(title: Column, word: str = EFFECTIVE_WORD) -> Column:
    """``2027-01-01`` out of ``... 2027-01-01 <word>``; empty if there is none."""
    return F.regexp_extract(title, rf"([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:{SPACES})?{word}", 1)


def effective_date(title: Column, word: str = EFFECTIVE_WORD) -> Column:
    """The effective date as a date; null if absent or not a calendar day."""
    return F.nullif(effective_date_text(title, word), F.lit("")).try_cast("date")


def months_later(d: Column, months: int) -> Column:
    """Same day number, months later, running over into the next month.

    30 November plus 3 gives 2 March, where ``add_months`` gives 28 February.
    """
    return F.date_add(F.add_months(F.trunc(d, "month"), months), F.dayofmonth(d) - 1)


def days_until(d: Column, as_of: Column) -> Column:
    return F.datediff(d, as_of)
