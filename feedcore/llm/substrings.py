"""Substring dedup with fixed-block anchors.

A repeat of ``window`` words holds at least one whole block of ``(window + 1) // 2``
words that starts at a multiple of that length in its document.  So:

1. Index and probe.  The blocks of every document are the index; the hashes of every
   rolling window of block length probe it.  Both are dealt out by hash.  A task
   sends each hash once however often it met it, so a passage that a third of all
   documents share costs one entry a task.  A block whose hash starts elsewhere too
   is a hit.
2. Extend.  Around its hits a document tests each window whose blocks are all hits:
   128-bit digests (two independent polynomials) are dealt out by hash again, and a
   bit comes back for each.  Runs of confirmed windows are the maximal exact repeats.

The text moves once, to meet its hits.  Documents without hits are done there; the
others wait in a staged table for the answers, a batch a row.

Words are maximal runs without ASCII white space, unchanged.  Nulls: a null text has
no words.  A null ``doc_id`` is kept as it is.  Repeated rows are documents of their
own, so their windows repeat.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from feedcore.llm.common import Rolling, as_bytes, bucket_bits, by_bytes, hidden, shown, stage, word_hashes

WINDOW = 35
_BLOCKS = Rolling(0x9E3779B97F4A7C15)
_FIRST = Rolling(0xC2B2AE3D27D4EB4F)
_SECOND = Rolling(0x165667B19E3779F9)
_BLOCK = np.dtype([("rest", "<u4"), ("doc", "<u8"), ("at", "<u4")])
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])
BATCH_BYTES = 8 << 20


class Batch:
    """The words of several texts in one row, and where each text lies."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.hashes, self.sizes = word_hashes(texts)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(len(self.hashes)) - self.starts[self.doc]

    def whole(self, n: int) -> np.ndarray:
        """Positions where ``n`` words of one text start."""
        return np.flatnonzero(self.at + n <= self.sizes[self.doc])


def text_ids(column: str = "text"):
    """64 bits of the text's key; documents that share them share hits, which are tested anyway."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def split_by(buckets: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the buckets in an ascending array of them."""
    return np.searchsorted(buckets, np.arange((1 << bits) + 1))


def hits(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """``(doc, at)``: blocks, by text id and word position, that start elsewhere too."""
    size = (window + 1) // 2

    def probe(rows):
        names = ["bucket", "single", "several", "blocks"]
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            own = Batch(as_bytes(batch, "text"))
            at = own.whole(size)
            if not len(at):
                continue
            keys = _BLOCKS.windows(own.hashes, size)[at] >> np.uint64(32 - bits)
            fixed = own.at[at] % size == 0
            blocks = np.empty(fixed.sum(), _BLOCK)
            blocks["rest"] = keys[fixed] & np.uint64(0xFFFFFFFF)
            blocks["doc"] = np.array(batch.column("doc"), np.int64).view(np.uint64)[own.doc[at][fixed]]
            blocks["at"] = own.at[at][fixed]
            block_buckets = keys[fixed] >> np.uint64(32)
            order = np.argsort(block_buckets, kind="stable")
            blocks, block_ends = blocks[order], split_by(block_buckets[order], bits)
            keys, counts = np.unique(keys, return_counts=True)
            ends = split_by(keys >> np.uint64(32), bits)
            rest = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            out = []
            for b in range(1 << bits):
                part, n = rest[ends[b] : ends[b + 1]], counts[ends[b] : ends[b + 1]]
                if len(part):
                    own_blocks = blocks[block_ends[b] : block_ends[b + 1]]
                    out.append((b, part[n == 1].tobytes(), part[n > 1].tobytes(), own_blocks.tobytes()))
            columns = [pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out))]
            yield pa.record_batch(columns, names)

    def join(table: pa.Table) -> pa.Table:
        single = np.sort(np.concatenate([np.frombuffer(x, "<u4") for x in table.column("single").to_pylist()]))
        several = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("several").to_pylist()])
        blocks = np.concatenate([np.frombuffer(x, _BLOCK) for x in table.column("blocks").to_pylist()])
        # Met once in one batch and several times in another is covered by "several".
        again = np.unique(np.concatenate([single[1:][single[1:] == single[:-1]], several, [np.uint32(0xFFFFFFFF)]]))
        rest = blocks["rest"]
        # The largest value counts as met again: hits are tested in full anyway.
        hit = blocks[again[np.searchsorted(again, rest)] == rest]
        return pa.table({"doc": hit["doc"].view(np.int64), "at": hit["at"].astype(np.int32)})

    sent = docs.select(text_ids().alias("doc"), "text").mapInArrow(probe, "bucket int, single binary, several binary, blocks binary")
    return sent.groupBy("bucket").applyInArrow(join, "doc long, at int")


def tested(own: Batch, found: list[list[int] | None], window: int) -> np.ndarray:
    """Positions of the windows all of whose blocks are hits."""
    size = (window + 1) // 2
    hit = np.zeros(len(own.hashes) + 1, np.int64)
    spots = [s + np.array(f, np.int64) for s, f in zip(own.starts, found) if f]
    if not spots:
        return np.empty(0, np.int64)
    hit[np.concatenate(spots)] = 1
    block = np.zeros(len(own.hashes) + 1, np.int64)
    block[:-1][own.at % size == 0] = 1
    sums = np.zeros((2, len(hit) + 1), np.int64)
    np.cumsum(hit, out=sums[0, 1:])
    np.cumsum(block, out=sums[1, 1:])
    at = own.whole(window)
    last = at + window - size + 1
    n_hit, n_block = sums[0, last] - sums[0, at], sums[1, last] - sums[1, at]
    return at[(n_hit == n_block) & (n_hit > 0)]


def digests(own: Batch, at: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and digest of the windows at some positions."""
    out = np.empty(len(at), _DIGEST)
    first = _FIRST.windows(own.hashes, window)[at] if len(at) else np.empty(0, np.uint64)
    out["a"] = first
    if len(at):
        out["b"] = _SECOND.windows(own.hashes, window)[at] >> np.uint64(32)
    return (first >> np.uint64(64 - bits)).astype(np.int64), out


class Groups:
    """Equal digests of an array: ``of`` numbers them in ascending order, ``counts`` has their sizes."""

    def __init__(self, found: np.ndarray) -> None:
        order = np.argsort(found["a"])
        own = found[order]
        if ((own["a"][1:] == own["a"][:-1]) & (own["b"][1:] != own["b"][:-1])).any():
            order = np.lexsort((found["b"], found["a"]))
            own = found[order]
        new = np.ones(len(own), bool)
        new[1:] = (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])
        starts = np.flatnonzero(new)
        self.values = own[starts]
        self.counts = np.diff(np.append(starts, len(own)))
        self.of = np.empty(len(own), np.int64)
        self.of[order] = np.cumsum(new) - 1


def covered(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``at``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


class Output:
    """Rows of documents with their repeats removed."""

    def __init__(self, columns: list[str], with_text: bool, schema: pa.Schema) -> None:
        self.columns, self.with_text, self.schema = columns, with_text, schema

    def of(self, batch: pa.RecordBatch, own: Batch, gone: np.ndarray) -> dict[str, pa.Array]:
        """``gone`` marks the words to remove."""
        removed, kept, spans, texts = [], [], [], None
        for text, start, end in zip(own.texts, own.starts, own.ends):
            words, mask = text.split(), gone[start:end]
            n = int(np.count_nonzero(mask))
            if not n:
                spans.append([])
                kept.append(b" ".join(words))
                removed.append(0)
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            spans.append([{"from_word": int(a), "to_word": int(b)} for a, b in edges.reshape(-1, 2)])
            kept.append(b" ".join(compress(words, ~mask)))
            removed.append(n)
        out = {c: batch.column(c) for c in self.columns if c != "text"}
        if self.with_text:
            old = batch.column("text").to_pylist()
            texts = [o if not n else k.decode() for o, n, k in zip(old, removed, kept)]
            out["text"] = pa.array(texts, pa.string())
        out["n_words"] = pa.array(own.sizes, pa.int64())
        out["n_removed"] = pa.array(removed, pa.int64())
        out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
        out["removed_spans"] = pa.array(spans, self.schema.field("removed_spans").type)
        return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``removed_spans`` of each document.

    ``with_text`` returns all columns of ``docs`` as well, ``text`` being the kept words
    joined by spaces (unchanged where nothing was removed).
    """
    given, docs = docs, hidden(docs)
    columns = docs.columns if with_text else ["doc_id"]
    bits = bucket_bits(docs, "text")
    result = T.StructType(
        [f for f in docs.schema if f.name in columns]
        + T._parse_datatype_string(
            "n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<from_word: long, to_word: long>>"
        ).fields
    )
    work = T._parse_datatype_string("batch string, bucket int, single binary, several binary, docs binary").fields
    schema = to_arrow_schema(T.StructType(result.fields + work))
    out = Output(columns, with_text, schema)

    def rows_of(own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.record_batch([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)

    def extend(rows):
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            found = batch.column("hits").to_pylist()
            waits = pa.array([bool(f) for f in found])
            calm = batch.filter(pc.invert(waits))
            if calm.num_rows:
                own = Batch(as_bytes(calm, "text"))
                yield rows_of(out.of(calm, own, np.zeros(len(own.hashes), bool)), calm.num_rows)
            batch = batch.filter(waits)
            if not batch.num_rows:
                continue
            own = Batch(as_bytes(batch, "text"))
            at = tested(own, [f for f in found if f], window)
            buckets, own_digests = digests(own, at, window, bits)
            name = uuid.uuid4().hex
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield rows_of({"batch": pa.array([name]), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())}, 1)
            order = np.argsort(buckets, kind="stable")
            ends = split_by(buckets[order], bits)
            parts = []
            for b in range(1 << bits):
                part = own_digests[order[ends[b] : ends[b + 1]]]
                if len(part):
                    groups = Groups(part)
                    once = groups.counts == 1
                    parts.append((b, groups.values[once].tobytes(), groups.values[~once].tobytes()))
            if parts:
                b, single, several = zip(*parts)
                probe = {"batch": pa.array([name] * len(b)), "bucket": pa.array(b, pa.int32())}
                probe |= {"single": pa.array(single, pa.binary()), "several": pa.array(several, pa.binary())}
                yield rows_of(probe, len(b))

    by_doc = hits(docs, window, bits).groupBy("doc").agg(F.collect_set("at").alias("hits"))
    keyed = docs.select(*{*columns, "text"}).withColumn("doc", text_ids())
    met = keyed.join(by_doc, "doc", "left").drop("doc")
    kept = stage(met.mapInArrow(extend, T.StructType(result.fields + work)), "repeats")

    def confirm(table: pa.Table) -> pa.Table:
        """For each batch the digests, in ascending order, that start elsewhere too."""
        single = [np.frombuffer(x, _DIGEST) for x in table.column("single").to_pylist()]
        several = [np.frombuffer(x, _DIGEST) for x in table.column("several").to_pylist()]
        groups = Groups(np.concatenate([*single, *several]))
        n = sum(map(len, single))
        again = groups.counts > 1
        again[groups.of[n:]] = True
        flags = np.split(again[groups.of[:n]], np.cumsum([len(x) for x in single])[:-1])
        bits_ = [np.packbits(f).tobytes() for f in flags]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(bits_, pa.binary())})

    probes = kept.where("bucket is not null").select("batch", "bucket", "single", "several")
    answers = probes.groupBy("bucket").applyInArrow(confirm, "batch string, bucket int, bits binary")
    answers = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    def finish(rows):
        final = to_arrow_schema(result)
        for row in rows:
            for data, told in zip(row.column("docs").to_pylist(), row.column("answers").to_pylist()):
                with pa.ipc.open_stream(data) as reader:
                    batch = reader.read_next_batch()
                own = Batch(as_bytes(batch, "text"))
                at = tested(own, batch.column("hits").to_pylist(), window)
                buckets, own_digests = digests(own, at, window, bits)
                order = np.argsort(buckets, kind="stable")
                ends = split_by(buckets[order], bits)
                gone = np.zeros(len(own.hashes), bool)
                sure = []
                for answer in told or ():
                    b = answer["bucket"]
                    part = order[ends[b] : ends[b + 1]]
                    groups = Groups(own_digests[part])
                    yes = groups.counts > 1
                    flags = np.unpackbits(np.frombuffer(answer["bits"], np.uint8))[: int((~yes).sum())]
                    yes[~yes] = flags.astype(bool)
                    sure.append(at[part[yes[groups.of]]])
                if sure:
                    gone = covered(len(own.hashes), np.concatenate(sure), window)
                made = out.of(batch, own, gone)
                yield pa.record_batch([made[f.name].cast(f.type) for f in final], schema=final)

    waiting = kept.where("docs is not null").select("batch", "docs").join(answers, "batch", "left")
    done = kept.where("batch is null").select(*result.names)
    every = done.unionByName(waiting.select("docs", "answers").mapInArrow(finish, result))
    return shown(every, given, ["n_words", "n_removed", "kept_sha256", "removed_spans"]) if with_text else every
