"""Elements of one name at any depth of a payload, by balanced tags.

A payload is cut into chunks, each of which ends with a tag that matters.  One pass
over the chunks, in the JVM, keeps a stack of what is open: a closing tag takes its
element off the stack, and only then is the element's content known.  Comments, CDATA
sections and other elements lie inside chunks and are never looked at.

In HTML a row also ends where the next row of the same table starts, where its table
ends, or with the page; a table inside a row keeps its rows to itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedcore.functions.text import let

#: The inside of a tag behind its name; quoted values may hold ``>``.
INSIDE_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: HTML elements whose rows are their own.
HTML_HOLDERS = {"tr": ("table", "thead", "tbody", "tfoot"), "li": ("ul", "ol", "menu")}

_ENTRY = "array<struct<at int, name string>>"
_DONE = "array<struct<at int, stop int>>"


def _chunks(body: Column, names: tuple[str, ...], flags: str) -> Column:
    any_name = "|".join(names)
    apart = rf"(?!/?(?:{any_name})[\s/>])"
    other = rf"[^<]++|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<{apart}/?[^\s<>!?/]{INSIDE_TAG}>|<{apart}"
    return F.regexp_extract_all(
        body, F.lit(rf"(?s{flags})(?:{other})*+(?:</?(?:{any_name})(?=[\s/>]){INSIDE_TAG}>|\z)"), F.lit(0)
    )


def _last_of(stack: Column, name: Column) -> Column:
    """Place (from 1) of the last entry of that name; 0 if there is none."""
    back = F.array_position(F.reverse(F.transform(stack, lambda s: s["name"])), name)
    return F.when(back > 0, F.size(stack) + 1 - back.cast("int")).otherwise(0)


def elements(body: Column, row: str, within: str | None = None) -> Column:
    """``array<struct<tag, inner>>``: each ``row`` element's opening tag and content, in document order.

    Without ``within`` names are XML's: any ``row`` may hold others.  With it they are HTML's, upper
    or lower case, and only rows somewhere below a ``within`` element count.
    """
    html = within is not None
    holders = tuple(dict.fromkeys((*HTML_HOLDERS.get(row, ()), within))) if html else ()
    flags = "i" if html else ""
    tag = rf"(?s{flags})</?(?:{'|'.join((row, *holders))})(?=[\s/>]){INSIDE_TAG}>\z"

    def named(name: Column) -> Column:
        return F.lower(name) if html else name

    def step(state: Column, chunk: Column) -> Column:
        stack, name, closing = state["stack"], chunk["name"], chunk["closing"]
        is_row, size = name == row, F.size(stack)
        top_is_row = F.coalesce(F.get(stack, size - 1)["name"] == row, F.lit(False))
        # How much of the stack stays when this tag has ended what it ends.
        stays = (
            F.when(closing & is_row, F.when(top_is_row, size - 1).otherwise(size))
            .when(closing, let(_last_of(stack, name), lambda last: F.when(last > 0, last - 1).otherwise(size)))
            .when(is_row & top_is_row & F.lit(html), size - 1)
            .otherwise(size)
        )
        return let(stays, lambda n: after(state, chunk, n))

    def after(state: Column, chunk: Column, stays: Column) -> Column:
        stack, done, i, name = state["stack"], state["done"], state["i"], chunk["name"]
        ended = F.filter(F.slice(stack, stays + 1, F.size(stack)), lambda s: s["name"] == row)
        counts = F.exists(stack, lambda s: s["name"] == within) if html else F.lit(True)
        opens = (name != "") & ~chunk["closing"] & ~chunk["alone"] & ((name != row) | counts)
        own = F.array(F.struct(i.alias("at"), i.alias("stop")))
        return F.struct(
            F.when(stays < F.size(stack), F.concat(done, F.transform(ended, lambda s: F.struct(s["at"].alias("at"), i.alias("stop")))))
            .when(chunk["alone"] & (name == row), F.concat(done, own))
            .otherwise(done)
            .cast(_DONE)
            .alias("done"),
            F.concat(
                F.slice(stack, 1, stays),
                F.when(opens, F.array(F.struct(i.alias("at"), name.alias("name")))).otherwise(F.array().cast(_ENTRY)),
            )
            .cast(_ENTRY)
            .alias("stack"),
            (i + 1).alias("i"),
        )

    def finish(state: Column) -> Column:
        """What the end of the payload leaves open ends there: HTML only."""
        if not html:
            return state["done"]
        rows = F.filter(state["stack"], lambda s: s["name"] == row)
        return F.concat(state["done"], F.transform(rows, lambda s: F.struct(s["at"].alias("at"), (state["i"] - 1).alias("stop")))).cast(_DONE)

    empty = F.struct(F.array().cast(_DONE).alias("done"), F.array().cast(_ENTRY).alias("stack"), F.lit(0).alias("i"))

    def content(parts: Column, found: Column) -> Column:
        at, stop = found["at"], found["stop"]
        opening, last = F.get(parts, at), F.get(parts, stop)
        inner = F.concat(
            F.array_join(F.transform(F.slice(parts, at + 2, F.greatest(stop - at - 1, F.lit(0))), lambda p: p["text"]), ""),
            F.substring(last["text"], F.lit(1), F.char_length(last["text"]) - F.char_length(last["tag"])),
        )
        return F.struct(opening["tag"].alias("tag"), F.when(stop > at, inner).otherwise(F.lit("")).alias("inner"))

    def piece(text: Column) -> Column:
        return let(
            F.regexp_extract(text, tag, 0),
            lambda t: F.struct(
                text.alias("text"),
                t.alias("tag"),
                named(F.regexp_extract(t, r"^</?([^\s/>]++)", 1)).alias("name"),
                t.startswith("</").alias("closing"),
                (F.lit(False) if html else t.endswith("/>")).alias("alone"),
            ),
        )

    pieces = F.transform(_chunks(F.coalesce(body, F.lit("")), (row, *holders), flags), piece)
    return let(
        pieces,
        lambda parts: F.transform(F.array_sort(F.aggregate(parts, empty, step, finish)), lambda found: content(parts, found)),
    )


def opening_tags(body: Column, name: str) -> Column:
    """How many opening tags of that name a payload has, at most (comments and CDATA are not left out)."""
    return F.regexp_count(body, F.lit(rf"<{name}(?=[\s/>])"))
