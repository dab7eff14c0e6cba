"""Line dedup with a log-template tree.

A line is a list of tokens.  Tokens with digits are fields and are masked.  The tree
has fixed depth: the number of tokens, then the leading tokens.  In a leaf, lines are
merged into templates: a line joins the template with which it shares most tokens in
place, if they are ``likeness`` of all or more, and places that differ become fields.
A template that occurs in ``min_docs`` documents or more is recurring; its lines go,
but for the first one (least ``doc_id``, then line), so that no content is lost.

Only lines whose leaf recurs at all are looked at.  Equal lines are counted before
they meet in a leaf.  The sorted lines of a leaf stream through one task, which holds
its templates only.  From ``leaf_lines`` templates on, those that a line can join are
looked up by the segments it must share with one of them; the result is the same.

Nulls: a null text has no lines.  Lines without a letter outside of fields, empty ones
too, always stay.  Repeated rows (same id and text) are one document.  Texts without
a dropped line stay as they are.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from feedcore.llm.common import by_bytes, hidden, shown, stage

FIELD = "<*>"
BATCH_BYTES = 8 << 20
_digit = re.compile(r"\d").search
_letter = re.compile(r"[^\W\d_]").search


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def masked(line: str) -> list[str]:
    """The line's tokens, fields masked; none if nothing is left to compare."""
    tokens = line.split()
    if not _digit(line):
        return tokens if _letter(line) else []
    tokens = [FIELD if _digit(t) else t for t in tokens]
    return tokens if any(map(_letter, tokens)) else []


def leaf_of(tokens: list[str], depth: int) -> int:
    """The leaf of a masked line: its number of tokens and the leading ones."""
    return hash64(f"{len(tokens)} " + " ".join(tokens[:depth]))


class Leaf:
    """Templates of lines of ``width`` tokens that begin alike in ``depth`` places.

    A line that may differ from a template in ``n`` places shares one of any ``n + 1``
    segments with it.  Tokens are compared by 64-bit hashes.
    """

    def __init__(self, width: int, likeness: float, depth: int, scanned: int) -> None:
        self.likeness, self.scanned, self.size, self.field = likeness, scanned, 0, hash(FIELD)
        self.rows = np.empty((4, width), np.int64)
        free = width - min(depth, width)
        misses = sum((width - n) / width >= likeness for n in range(1, width + 1))
        ends = [width - free + free * i // (misses + 1) for i in range(misses + 2)]
        # Where all may differ, a segment is empty and shared by all.
        self.segments = list(zip(ends, ends[1:]))
        self.index: dict[tuple[int, bytes], set[int]] = {}

    def _enter(self, template: int) -> None:
        for key in self._keys(self.rows[template]):
            self.index.setdefault(key, set()).add(template)

    def _keys(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(i, row[a:b].tobytes()) for i, (a, b) in enumerate(self.segments)]

    def join(self, tokens: list[str]) -> int:
        """The template, by number, that a masked line falls to."""
        row = np.array([hash(t) for t in tokens], np.int64)
        indexed = self.size > self.scanned
        if indexed:
            found = sorted(set().union(*(self.index.get(key, ()) for key in self._keys(row))))
            rows = self.rows[found]
        else:
            rows = self.rows[: self.size]
        if len(rows):
            same = (rows == row).mean(1)
            best = int(same.argmax())
            if same[best] >= self.likeness:
                best = found[best] if indexed else best
                if (differ := self.rows[best] != row).any():
                    self.rows[best][differ] = self.field
                    if indexed:
                        self._enter(best)
                return best
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.size] = row
        self.size += 1
        if indexed:
            self._enter(self.size - 1)
        elif self.size > self.scanned:
            for template in range(self.size):
                self._enter(template)
        return self.size - 1


def merge(lines: list[str], likeness: float, depth: int = 0, scanned: int = 1000) -> list[int]:
    """The template, by number, that each masked line of a leaf falls to, in the order given."""
    rows = [line.split(" ") for line in lines]
    leaf = Leaf(len(rows[0]), likeness, depth, scanned)
    return [leaf.join(row) for row in rows]


def row_key():
    """128 bits of a document's id and text."""
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)))


def recurring(docs: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """``(doc, leaves)``: the leaves of a document that occur in ``min_docs`` documents or more."""

    def run(rows):
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            keys, leaves = [], []
            for key, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                own = {leaf_of(m, depth) for m in map(masked, set((text or "").split("\n"))) if m}
                leaves += own
                keys += [key] * len(own)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(leaves, pa.int64())], ["doc", "leaf"])

    seen = stage(docs.select(row_key().alias("doc"), "text").mapInArrow(run, "doc binary, leaf long"), "leaves")
    often = seen.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return seen.join(often, "leaf").groupBy("doc").agg(F.collect_set("leaf").alias("leaves"))


def drop_recurring(
    docs: DataFrame, min_docs: int = 3, likeness: float = 0.7, depth: int = 3, leaf_lines: int = 1000
) -> DataFrame:
    """All columns of ``docs``, ``text`` without recurring lines, and ``n_lines``, ``n_dropped``."""
    given, docs = docs, hidden(docs)
    work = T._parse_datatype_string("doc binary, line_no int, line long, leaf long, masked string").fields
    result = T.StructType(docs.schema.fields + T._parse_datatype_string("n_lines long, n_dropped long").fields)
    schema = to_arrow_schema(T.StructType(result.fields + work))
    names = docs.columns

    def filled(n: int, own: dict) -> pa.RecordBatch:
        return pa.record_batch([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)

    def look(rows):
        """Each document, and its lines in recurring leaves."""
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            found: dict[str, list] = {f.name: [] for f in work}
            counts = []
            columns = (batch.column(c).to_pylist() for c in ("_doc", "text", "_leaves"))
            for key, text, leaves in zip(*columns):
                lines, leaves = (text or "").split("\n"), set(leaves or ())
                counts.append(len(lines) if text else 0)
                for i, line in enumerate(lines if leaves else ()):
                    tokens = masked(line)
                    if tokens and (leaf := leaf_of(tokens, depth)) in leaves:
                        whole = " ".join(tokens)
                        row = (key, i, hash64(whole), leaf, whole)
                        for column, value in zip(found.values(), row):
                            column.append(value)
            own = {n: batch.column(n) for n in names}
            own |= {"n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array([0] * len(counts), pa.int64()), "doc": batch.column("_doc").cast(pa.binary())}
            yield filled(batch.num_rows, own)
            if found["doc"]:
                n = len(found["doc"])
                yield filled(n, {f.name: pa.array(found[f.name], schema.field(f.name).type) for f in work} | {"doc_id": pa.nulls(n, schema.field("doc_id").type)})

    keyed = docs.withColumn("_doc", row_key())
    leaves = recurring(docs, depth, min_docs).select(F.col("doc").alias("_doc"), F.col("leaves").alias("_leaves"))
    kept = stage(keyed.join(leaves, "_doc", "left").mapInArrow(look, T.StructType(result.fields + work)), "lines")
    rows = kept.where("line_no is null")
    seen = kept.where("line_no is not null").select("doc", "line_no", "line", "leaf", "masked")

    per_doc = seen.groupBy("line", "doc").agg(F.first("leaf").alias("leaf"), F.first("masked").alias("masked"))
    different = per_doc.groupBy("line").agg(
        F.count("*").alias("n"), F.min("leaf").alias("leaf"), F.min("masked").alias("masked")
    )

    def parse(rows):
        """Lines come leaf by leaf, in the order of merging."""
        now, names = None, []
        for batch in rows:
            lines, told = batch.column("line").to_pylist(), []
            for leaf, line, text in zip(batch.column("leaf").to_pylist(), lines, batch.column("masked").to_pylist()):
                tokens = text.split(" ")
                if leaf != now:
                    now, names, found = leaf, [], Leaf(len(tokens), likeness, depth, leaf_lines)
                template = found.join(tokens)
                if template == len(names):
                    names.append(line)
                told.append(names[template])
            yield pa.record_batch([batch.column("line"), pa.array(told, pa.int64())], ["line", "template"])

    ordered = different.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "masked")
    templates = stage(ordered.select("leaf", "line", "masked").mapInArrow(parse, "line long, template long"), "templates")
    placed = seen.select("doc", "line_no", "line").join(templates, "line")
    often = placed.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    order = rows.select("doc", "doc_id").distinct()
    hit = stage(placed.join(often.select("template"), "template").join(order, "doc").select("template", "doc_id", "doc", "line_no"), "hits")
    first = hit.groupBy("template").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "doc", "line_no")).alias("first"))
    first = first.select("template", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_no"))
    gone = hit.join(first, "template").where("doc <> first_doc or line_no <> first_no")
    gone = gone.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))

    def cut(batches):
        final = to_arrow_schema(result)
        for batch in batches:
            texts, dropped = [], []
            for text, gone_ in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                if gone_:
                    out = set(gone_)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)
                texts.append(text)
                dropped.append(len(gone_ or ()))
            own = {"text": pa.array(texts, pa.string()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.record_batch([own[f.name] if f.name in own else batch.column(f.name) for f in final], schema=final)

    told = rows.select("doc", *result.names).join(gone, "doc", "left").drop("doc").mapInArrow(cut, result)
    return shown(told, given, ["n_lines", "n_dropped"])
