r"""Chat formatting from event logs.

A log holds events of messages: ``message`` opens one, ``delta`` appends what was
streamed, ``edit`` and ``regenerate`` replace the text so far, ``retract`` takes the
message back.  The log is partitioned by conversation and sorted by position and
sequence; one pass folds it into final messages and renders them.  Rows stream
through, so a conversation of any length needs the memory of one message.

Template: ``<s>`` starts a conversation; ``[INST] user [/INST]``, ``assistant</s>``,
``<<SYS>>system<</SYS>>``, and ``[ROLE]name[/ROLE]text[/TEXT]`` for any other role.  In
texts a backslash is doubled, and one is put behind the first character of each
control string, so no text holds a mark and :func:`unescape` gives every text back.

Nulls: a null text or role is empty, a null position sorts first, a null conversation
is one of its own.  Repeated rows are messages of their own.  Ties in position are
ordered by sequence, role, text.  An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import batch_of

START = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TEXT]")
#: The control strings that must never stand in a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TEXT]")
_ESCAPED = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_BACK = re.compile(r"\\(\\?)")

RENDERED = "conv_id long, turn_no long, rendered string, loss_start long, loss_end long"
_RENDERED = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns (with or without the start mark)."""
    at = len(START) if formatted.startswith(START) else 0
    turns = []
    while at < len(formatted):
        role = next((r for r in ("user", "system") if formatted.startswith(MARKS[r][0], at)), "assistant")
        if role == "assistant" and formatted.startswith(OTHER[0], at):
            end = formatted.index(OTHER[1], at)
            role = unescape(formatted[at + len(OTHER[0]) : end])
            head, tail = end + len(OTHER[1]), OTHER[2]
        else:
            head, tail = at + len(MARKS[role][0]), MARKS[role][1]
        end = formatted.index(tail, head)
        turns.append((role, unescape(formatted[head:end])))
        at = end + len(tail)
    return turns


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages ``(conv_id, position, role, text)`` of sorted events."""
    key, role, parts, is_open = None, "", [], False
    for conv, position, kind, own_role, own in events:
        if kind == "message":
            if is_open:
                yield *key, role, "".join(parts)
            key, role, parts, is_open = (conv, position), own_role or "", list(own), True
        elif not is_open or key != (conv, position):
            continue  # an event of a message that was never opened
        elif kind == "delta":
            parts += own
        elif kind in ("edit", "regenerate"):
            parts = list(own)
        elif kind == "retract":
            is_open = False
    if is_open:
        yield *key, role, "".join(parts)


def format_log(events: DataFrame) -> DataFrame:
    """Rendered turns in order, of ``(conv_id, position, seq, kind, role, parts)``.

    ``parts`` is the list of streamed pieces of the event.  The formatted
    conversation is the concatenation of its ``rendered`` rows; ``loss_start`` and
    ``loss_end`` are the offsets of assistant text in it, null for other turns.  Rows
    of a conversation stay together and in order within their partition.
    """
    # An opening comes before what happens to it, whatever the names sort as.
    opens = F.when(F.col("kind") == "message", 0).otherwise(1)
    log = events.select("conv_id", "position", "seq", "kind", "role", "parts").withColumn("_opens", opens)
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "position", "seq", "_opens", "role", "parts")

    def run(rows):
        def lines():
            for batch in rows:
                columns = [batch.column(n).to_pylist() for n in ("conv_id", "position", "kind", "role", "parts")]
                for conv, position, kind, role, parts in zip(*columns):
                    yield conv, position, kind, role, [p for p in parts or () if p]

        out, conv, turn, offset, size = [], object(), 0, 0, 0
        for own, _, role, text in fold(lines()):
            piece, start, end = render(role, text)
            if own != conv:
                conv, turn, offset = own, 0, 0
                piece, start, end = START + piece, start + len(START), end + len(START)
            loss = (offset + start, offset + end) if role == "assistant" else (None, None)
            out.append((conv, turn, piece, *loss))
            turn, offset, size = turn + 1, offset + len(piece), size + len(piece)
            if len(out) >= 2000 or size > 4_000_000:
                yield batch_of(_RENDERED, *zip(*out))
                out, size = [], 0
        if out:
            yield batch_of(_RENDERED, *zip(*out))

    return log.mapInArrow(run, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """One row a conversation, made from the formatted text and the loss mask alone."""

    def run(rows):
        out, conv, state = [], object(), None

        def close():
            turns, all_turns, chars, loss, total = state
            return conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in rows:
            for own, _, piece, start, end in zip(*(batch.column(n).to_pylist() for n in _RENDERED.names)):
                if own != conv:
                    if state:
                        out.append(close())
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    text = unescape(piece[start - state[4] : end - state[4]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
            if len(out) >= 2000:
                yield batch_of(_DIGESTS, *zip(*out))
                out = []
        if state:
            out.append(close())
        if out:
            yield batch_of(_DIGESTS, *zip(*out))

    return rendered.mapInArrow(run, DIGESTS)


def pieces_of(text: Column, size: int) -> Column:
    """A text as the list of pieces that a stream would have brought."""
    at = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    cut = F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def log_of_turns(turns: DataFrame, size: int = 256) -> DataFrame:
    """The log of plain rows ``(conv_id, turn, role, text)``: each opens a message and streams its text."""
    return turns.select(
        "conv_id",
        F.col("turn").alias("position"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        pieces_of(F.col("text"), size).alias("parts"),
    )
