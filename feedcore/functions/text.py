"""Text expressions: cleaning, entity decoding, title splitting, title keys.

Everything here is a Column built from Spark's own functions, so it stays in
the JVM and next to the scan.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Python's str.strip and \s see it: Unicode White_Space, which is
# Java's (?U)\s, and four control characters.
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACES = r"(?U:[\s\x1c-\x1f]+)"

# An entity as the HTML standard reads it, or the text between two of them.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_PIECES = rf"{_ENTITY}|[^&]+|&"
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\xa0", "amp": "&"}
_UNCOMMON = rf"&(?!(?:{'|'.join(_COMMON)});)(?:#[0-9xX]|[^\t\n\f <&#;])"

_CLOSED_NAMES = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_OPEN_NAMES = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Fix the named columns as values, so that filters on them stay above.

    Spark pushes a filter below the projection that computes its column and
    repeats the whole expression there, once per keyword of a keyword filter.
    A one-row ``inline`` is a step it does not push filters through.
    """
    carried = [c for c in df.columns if c not in names]
    return df.select(*carried, F.inline(F.array(F.struct(*names))))


def strip(c: Column) -> Column:
    """Drop white space at both ends, Unicode spaces included."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def _character(number: Column) -> Column:
    """The character with the given code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _literal_map(table: dict[str, str]) -> Column:
    # One foldable string instead of thousands of literals keeps plans small.
    body = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(body), F.lit("\x01"), F.lit("\x02"))


def _numeric_entity(piece: Column) -> Column:
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(piece, r"^&#0*([0-9]*)", 1)
    is_hex = piece.rlike(r"^&#[xX]")
    digits = F.when(is_hex, hexadecimal).otherwise(decimal)
    number = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).otherwise(
        F.when(is_hex, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10))
        .otherwise(F.concat(F.lit("0"), decimal))
        .cast("long")
    )
    # Old pages write Windows-1252 byte values as character numbers.
    windows = {
        str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)
    }
    return (
        F.when(number == 0, F.lit("\ufffd"))
        .when(number == 0x0D, F.lit("\r"))
        .when(number.between(0x80, 0x9F), F.element_at(_literal_map(windows), number.cast("string")))
        .when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(
            number.between(0x01, 0x08)
            | (number == 0x0B)
            | number.between(0x0E, 0x1F)
            | (number == 0x7F)
            | number.between(0xFDD0, 0xFDEF)
            | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE),
            F.lit(""),
        )
        .otherwise(_character(number))
    )


def _named_entity(piece: Column) -> Column:
    name = F.substring(piece, 2, 64)
    closed = F.when(
        F.endswith(name, F.lit(";")),
        F.element_at(_literal_map(_CLOSED_NAMES), F.regexp_replace(name, ";", "")),
    )
    longest_first = sorted(_OPEN_NAMES, key=len, reverse=True)
    opened = F.regexp_extract(name, rf"^(?:{'|'.join(longest_first)})", 0)
    return F.coalesce(
        closed,
        F.when(
            opened != "",
            F.concat(F.element_at(_literal_map(_OPEN_NAMES), opened), F.substr(name, F.length(opened) + 1)),
        ),
        piece,
    )


def unescape(c: Column) -> Column:
    """Decode HTML entities in one pass.

    Text without ``&`` passes through; text with common entities only takes a
    chain of ``replace`` (``&amp;`` last, so nothing is decoded twice); the rest
    is cut into entities and text in between and decoded piece by piece.
    """
    common = c
    for name, value in _COMMON.items():
        common = F.replace(common, F.lit(f"&{name};"), F.lit(value))
    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    decoded = F.transform(
        pieces,
        lambda p: F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p)
        .when(F.startswith(p, F.lit("&#")), _numeric_entity(p))
        .otherwise(_named_entity(p)),
    )
    return (
        F.when(~F.contains(c, F.lit("&")), c)
        .when(~c.rlike(_UNCOMMON), common)
        .otherwise(F.array_join(decoded, ""))
    )


def clean_text(c: Column) -> Column:
    """Collapse white space, decode entities, strip: in that order.

    A no-break space that appears only on decoding therefore survives inside
    the text and is stripped at its ends.
    """
    return let(collapse_space(F.coalesce(c, F.lit(""))), lambda t: strip(unescape(t)))


def strip_tags(c: Column) -> Column:
    """Remove markup, then clean."""
    text = F.coalesce(c, F.lit(""))
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text)
    return clean_text(bare)


_MARKUP = r"(?s)<!--.*?-->|<[!?/a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def markup_text(c: Column, separator: str = "") -> Column:
    """Text of an HTML fragment: each text node stripped, empty ones dropped."""
    nodes = F.transform(F.split(c, _MARKUP), lambda t: strip(unescape(t)))  # t is computed once
    return F.array_join(F.filter(nodes, lambda t: t != ""), separator)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, decoded; empty if absent."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    groups = [F.nullif(F.regexp_extract(tag, pattern, g), F.lit("")) for g in (1, 2, 3)]
    return let(F.coalesce(*groups, F.lit("")), unescape)


def title_without_outlet(title: Column) -> Column:
    """Part of ``title`` before its last ``" - "``; all of it if there is none."""
    tail = F.substring_index(title, " - ", -1)
    head = F.left(title, F.length(title) - F.length(tail) - 3)
    return F.when(F.contains(title, F.lit(" - ")), strip(head)).otherwise(title)


def outlet_of_title(title: Column, default: str) -> Column:
    """Part of ``title`` after its last ``" - "``; ``default`` if there is none."""
    return F.when(
        F.contains(title, F.lit(" - ")), strip(F.substring_index(title, " - ", -1))
    ).otherwise(F.lit(default))


# What a title key drops and keeps, and how many characters it has.
TITLE_TAG = r"\[[^\]]*\]"
TITLE_KEEP = "가-힣a-zA-Z0-9"
TITLE_KEY_LENGTH = 24

# The key is done once enough characters are kept, however long the title is.
_KEY_SPAN = rf"^(?:[^{TITLE_KEEP}]*+[{TITLE_KEEP}]){{0,{TITLE_KEY_LENGTH}}}+"


def title_key(title: Column) -> Column:
    """Key under which two titles count as the same story.

    Bracketed tags go, then all but Hangul syllables, letters and digits; of the
    rest, in lower case, the first 24 characters count.
    """
    whole = F.coalesce(title, F.lit(""))
    bare = F.when(
        F.contains(whole, F.lit("[")), F.regexp_replace(whole, TITLE_TAG, "")
    ).otherwise(whole)
    return F.lower(
        F.regexp_replace(F.regexp_extract(bare, _KEY_SPAN, 0), f"[^{TITLE_KEEP}]+", "")
    )


def short_name(title: Column) -> Column:
    """Title up to its first bracket or middle dot."""
    return strip(F.regexp_extract(title, "^[^(·]*", 0))


def first_non_empty(*columns: Column) -> Column:
    """First column with text in it after stripping, else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))
