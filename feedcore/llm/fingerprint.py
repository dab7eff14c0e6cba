"""Merkle fingerprints.

A text is a tree: blocks of code points below paragraphs (lines), paragraphs below
sections (runs of paragraphs), sections below the root.  Equal roots mean equal
texts; where roots differ, the sections and then the paragraphs that differ locate
the edit.  The fingerprint string is the root and the smallest hashes of blocks:
its length is bounded, and two of them give the share of blocks in common.

Nulls: a null text counts as empty.  A null ``doc_id`` sorts first.  Repeated ids are
ordered by text.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import batch_of, mixed, stage

BLOCK = 16
SECTION = 16
SKETCH = 64
_POWERS = mixed(np.arange(1, BLOCK + 1, dtype=np.uint64), 7) | np.uint64(1)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def levels(text: str) -> tuple[bytes, list[bytes], list[bytes]]:
    """Root, sections, paragraphs."""
    paragraphs = [digest(p.encode()) for p in text.split("\n")]
    sections = [digest(b"".join(paragraphs[i : i + SECTION])) for i in range(0, len(paragraphs), SECTION)]
    return digest(b"".join(sections)), sections, paragraphs


def blocks(text: str) -> np.ndarray:
    """64-bit hashes of the blocks; each paragraph starts a new block."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64)
    starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    line = np.zeros(len(codes), np.int64)
    line[starts[starts < len(codes)]] = starts[starts < len(codes)]
    inside = np.arange(len(codes)) - np.maximum.accumulate(line)
    at = inside % BLOCK
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((codes + np.uint64(1)) * _POWERS[at], np.flatnonzero(at == 0))
    return mixed(sums, 3)


def fingerprint(text: str) -> str:
    """``root:sketch``, the sketch in ascending order, 8 hex digits a block."""
    smallest = np.unique(blocks(text) >> np.uint64(32))[:SKETCH].astype(">u4")
    return f"{levels(text)[0].hex()}:{smallest.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 if the roots are equal, else the estimated share of blocks in common (below 1)."""
    (root_a, x), (root_b, y) = a.split(":"), b.split(":")
    if root_a == root_b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
    both = x | y
    # Short sketches are whole sets; long ones are compared over the smallest of both.
    least = sorted(both)[: SKETCH if max(len(x), len(y)) == SKETCH else len(both)]
    joint = sum(h in x and h in y for h in least)
    share = 2 * joint / (len(least) + joint) if least else 0.0
    return min(share, 0.9999)


def tree(docs: DataFrame) -> DataFrame:
    """All nodes: ``(doc_id, level, idx, hash)``, level 0 the root, 1 sections, 2 paragraphs."""

    def run(rows):
        for batch in rows:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                root, sections, paragraphs = levels(text or "")
                for level, nodes in enumerate(([root], sections, paragraphs)):
                    out += [(key, level, i, h.hex()) for i, h in enumerate(nodes)]
                if len(out) > 50_000:
                    yield _nodes(out)
                    out = []
            if out:
                yield _nodes(out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, level int, idx long, hash string")


def _nodes(out: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string())])
    return batch_of(schema, *zip(*out))


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """The branches that differ between two sets of nodes of the same documents, root first."""
    a, b = old.withColumnRenamed("hash", "old_hash"), new.withColumnRenamed("hash", "new_hash")
    both = a.join(b, ["doc_id", "level", "idx"], "full")
    return both.where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def edited(text: str, following: str) -> str:
    """The last half replaced by as many code points from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(key, text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    sha = hashlib.sha256(changed.encode()).hexdigest()
    return key, len(text), sha, own, print_, likeness(own, print_), likeness(own, next_own)


def with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next one by ``doc_id``.

    The text moves once, by range of ``doc_id``.  A task compares neighbours as rows
    stream by; the first and the last row of each range go to a staged side output,
    and the ranges are joined there (two rows a range).
    """
    ranges = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = _OUT.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))

    def run(rows):
        part, before, out = TaskContext.get().partitionId(), None, []
        blank = (None,) * (len(_OUT) - 1)
        for batch in rows:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = fingerprint(text)
                if before is None:
                    out.append((key, *blank, part, "first", text))
                else:
                    out.append((*compared(*before, text, own), None, None, None))
                before = key, text, own
            if out:
                yield batch_of(schema, *zip(*out))
                out = []
        if before is not None:
            yield batch_of(schema, *zip((before[0], *blank, part, "last", before[1])))

    kept = stage(ranges.mapInArrow(run, f"{RESULT}, part int, edge string, text string"), "prints")
    edges = kept.where("edge is not null")
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())
    links = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    last = edges.where("edge = 'last'").select("part", "doc_id", "text").join(links, "part")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))

    def ends(rows):
        for batch in rows:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "text", "following")]
            out = [compared(k, t, fingerprint(t), f, fingerprint(f)) for k, t, f in zip(*columns)]
            if out:
                yield batch_of(_OUT, *zip(*out))

    joined = last.join(first, "next_part").select("doc_id", "text", "following").mapInArrow(ends, RESULT)
    return kept.where("edge is null").select(*_OUT.names).unionByName(joined)
