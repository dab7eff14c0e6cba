"""Large JSON arrays read in parallel, byte range by byte range.

Where a byte range starts, nothing tells whether the place lies in a string, or how deep.
So ranges are read twice.  First each range gives what it does to either state: whether
its quotes change in and out of a string, and by how much its brackets change the depth
if it starts outside or inside of one.  These few numbers a range are chained on the
driver.  Then each range, now knowing its state, gives the records that start in it, and
reads on to the end of its last one.  No border is guessed.

Nulls and scalars in the array are left out; nested arrays are records like objects.  A
file that is no array or ends too early is reported and gives nothing; an empty one gives nothing.
Files are opened with Arrow's file systems.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = 64 << 20
PIECE = 4 << 20
AHEAD = 1 << 14
#: Bytes read in a task at least, if there are tasks for all cores.
TASK_BYTES = 32 << 20
_EFFECT_SQL = "file string, start long, quotes int, change array<long>, opens array<array<array<long>>>, array boolean"
_LONGS = pa.list_(pa.int64())
_EFFECT = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int32()), ("change", _LONGS)]
    + [("opens", pa.list_(pa.list_(_LONGS))), ("array", pa.bool_())]
)
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def opened(path: str):
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def pieces(source, start: int, stop: int, size: int = PIECE, *, border: int | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """``(offset, bytes, the same with escapes blanked)`` from ``start`` on.

    Beyond ``border`` pieces begin small, as mostly the end of one record is looked for.  Whether the first byte is escaped follows from the backslashes before it.
    """
    at, escaped = start, False
    while at > 0 and source.read_at(1, at - 1) == b"\\":
        escaped, at = not escaped, at - 1
    at, ahead = start, AHEAD
    border = stop if border is None else border
    while at < stop:
        if at < border:
            wanted = border - at
        else:
            wanted, ahead = ahead, 2 * ahead
        data = source.read_at(min(size, wanted, stop - at), at)
        if not data:
            return
        plain = b"_" + data[1:] if escaped else data
        plain = _ESCAPED.sub(b"__", plain)
        escaped = plain.endswith(b"\\")
        yield at, data, plain
        at += len(data)


def effect(source, start: int, stop: int) -> tuple[int, list[int], list[dict[int, int]]]:
    """What a range does: quotes modulo two and, from outside and from inside a string, the change
    of depth and how many brackets open, by the depth they open to (from the range's start)."""
    quotes, change, opens = 0, [0, 0], [Counter(), Counter()]
    for _, _, plain in pieces(source, start, stop):
        data = np.frombuffer(plain, np.uint8)
        within = (np.cumsum(data == 34) + quotes) & 1
        step = _STEP[data]
        for state in (0, 1):
            own = np.where(within == state, step, 0)
            depths = np.cumsum(own) + change[state]
            levels, counts = np.unique(depths[own == 1], return_counts=True)
            opens[state].update(dict(zip(levels.tolist(), counts.tolist())))
            change[state] = int(depths[-1])
        quotes = int(within[-1])
    return quotes, change, opens


def records(source, start: int, stop: int, size: int, within: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, text)`` of the records at depth one that start in the range."""
    held, first = [], -1
    for at, data, plain in pieces(source, start, size, border=stop):
        codes = np.frombuffer(plain, np.uint8)
        inside = (np.cumsum(codes == 34) + within) & 1
        step = np.where(inside == 0, _STEP[codes], 0)
        depths = np.cumsum(step) + depth
        within, depth = int(inside[-1]), int(depths[-1])
        # A record opens from depth one to two and closes from two to one.
        opens = np.flatnonzero((step == 1) & (depths == 2)).tolist()
        closes = np.flatnonzero((step == -1) & (depths == 1)).tolist()
        before = 0
        if first >= 0:
            if not closes:
                held.append(data)
                continue
            yield first, b"".join([*held, data[: closes[0] + 1]])
            held, first, before = [], -1, 1
        elif closes and (not opens or closes[0] < opens[0]):
            before = 1  # the end of a record that started in an earlier range
        for i, j in zip(opens, [*closes[before:], None]):
            if at + i >= stop:
                return
            if j is None:
                held, first = [data[i:]], at + i
            else:
                yield at + i, data[i : j + 1]
        if first < 0 and at + len(data) >= stop:
            return


def array_records(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, list[str]]:
    """``(file, pos, text)`` of every record, ``pos`` counted from 0, and the files that hold no whole array.

    To the driver: a row a range of ``split`` bytes.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    ranges = [(r.path, a, min(r.length, a + split), r.length) for r in listed for a in range(0, max(1, r.length), split)]
    form = "file string, start long, stop long, size long"
    # A task reads many short ranges, or starting tasks would cost more than reading.
    wanted = max(4 * spark.sparkContext.defaultParallelism, sum(r.length for r in listed) // TASK_BYTES)
    tasks = max(1, min(100_000, len(ranges), wanted))
    by_file: dict[str, list[tuple]] = {}
    for r in ranges:
        by_file.setdefault(r[0], []).append(r)

    def effects(batches):
        for batch in batches:
            out = []
            for file, start, stop, size in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(file) as source:
                    told = effect(source, start, stop)
                    head = source.read_at(min(size, 1 << 16), 0).lstrip()[:1] if start == 0 else b""
                out.append((file, start, told[0], told[1], [list(x.items()) for x in told[2]], head == b"["))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _EFFECT)], schema=_EFFECT)

    given = spark.createDataFrame(ranges, form).repartition(tasks, "file", "start")
    told = given.mapInArrow(effects, _EFFECT_SQL).collect()
    by_place = {(r.file, r.start): r for r in told}
    known, broken = [], []
    for row in listed:
        own, within, depth, base = [], 0, 0, 0
        for file, start, stop, size in by_file[row.path]:
            own.append((file, start, stop, size, within, depth, base))
            here = by_place[file, start]
            base += sum(n for level, n in here.opens[within] if depth + level == 2)
            depth, within = depth + here.change[within], within ^ here.quotes
        if within or depth or not by_place[row.path, 0].array:
            broken.append(row.path)
        else:
            known += own
    result = "file string, pos long, text string"
    if not known:
        return spark.createDataFrame([], result), broken

    def read(batches):
        for batch in batches:
            for file, start, stop, size, within, depth, base in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(file) as source:
                    out, held = [], 0
                    for i, (_, text) in enumerate(records(source, start, stop, size, within, depth)):
                        out.append((file, base + i, text.decode("utf-8", "replace")))
                        held += len(text)
                        if held > PIECE:
                            yield pa.record_batch([pa.array(c) for c in zip(*out)], ["file", "pos", "text"])
                            out, held = [], 0
                    if out:
                        yield pa.record_batch([pa.array(c) for c in zip(*out)], ["file", "pos", "text"])

    placed = spark.createDataFrame(known, f"{form}, inside int, depth long, base long").repartition(tasks, "file", "start")
    return placed.mapInArrow(read, result), broken


def write_arrays(texts: DataFrame, path: str) -> None:
    """A column of JSON objects as JSON arrays, one a partition."""
    column = texts.columns[0]

    def run(batches):
        first = True
        for batch in batches:
            lines = [("[" if first and not i else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
            first = first and not lines
            yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
        yield pa.record_batch([pa.array(["[]" if first else "]"])], ["value"])

    texts.select(F.col(column).cast("string")).mapInArrow(run, "value string").write.text(path)
