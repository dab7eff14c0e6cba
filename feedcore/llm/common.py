"""What several operators share: staged tables, byte words, 64-bit mixing, components."""

from __future__ import annotations

import contextlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedcore.session import shared_folder


#: Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    A lost executor then costs the tasks that ran on it, never the steps before.  The
    shuffle files of the step are gone when its table is there.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for paths in _LISTS:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_LISTS: list[list[str]] = []


@contextlib.contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The folders that ``stage`` writes in the block."""
    paths: list[str] = []
    _LISTS.append(paths)
    try:
        yield paths
    finally:
        _LISTS[:] = [x for x in _LISTS if x is not paths]


def release(docs: DataFrame, paths: list[str]) -> None:
    """Delete staged folders, unless ``docs`` still reads one of them."""
    spark = docs.sparkSession
    if not paths or any(path.split("/feedcore/")[-1] in file for file in docs.inputFiles() for path in paths):
        return
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_worker(key: tuple, make):
    """What ``make`` gives, once a Python worker: its later tasks find it again.

    The functions of this package travel by value, so their globals are a task's own;
    a module that is registered by name stays.
    """
    kept = sys.modules.setdefault("_feedcore_worker", types.ModuleType("_feedcore_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def clear_worker() -> None:
    """What other operators' tasks kept by ``in_worker`` goes: a task with much memory of its own starts without it."""
    if "_feedcore_worker" in sys.modules:
        for name in [n for n in sys.modules["_feedcore_worker"].__dict__ if not isinstance(n, str)]:
            del sys.modules["_feedcore_worker"].__dict__[name]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_key(column: str | Column) -> Column:
    """128-bit key of a text (null counts as empty), made in the JVM."""
    return F.unhex(F.md5(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of the 64-bit Murmur hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
HASHED_AT_ONCE = 1 << 20


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and the number of words of each.

    Words are runs without ASCII white space.  A word's hash is the sum of its bytes,
    each times a random factor of its place, and its length, mixed.  ``lower`` takes A-Z as a-z.
    """
    hashes, counts, at = [], [], 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < HASHED_AT_ONCE):
            part.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        if lower:
            data = _LOWER[data]
        gap = _WHITE[data]
        before = np.concatenate(([True], gap[:-1]))
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        borders = np.cumsum([0] + [len(t) + 1 for t in part])
        counts.append(np.diff(np.searchsorted(starts, borders)))
        if not len(starts):
            continue
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        letters = data[~gap].astype(np.uint64)
        place = np.arange(len(letters)) - np.repeat(first, sizes)
        factors = mixed(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64), 17) | np.uint64(1)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat((letters + np.uint64(1)) * factors[place], first)
            hashes.append(mixed(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 19))
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(counts or [np.empty(0, np.int64)])


class Rolling:
    """Polynomial hashes modulo 2**64 of every window of a sequence of word hashes.

    The hash of ``n`` words at ``i`` is ``sum(w[i+k] * b**k)``.  Two bases give
    128 bits where equality has to be sure.
    """

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("_powers", self.base), ("_inverses", self.inverse)):
                    steps = np.full(size, b, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        if len(words) < n:
            return np.empty(0, np.uint64)
        self._grow(len(words))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * self._powers[: len(words)], out=sums[1:])
            return mixed((sums[n:] - sums[:-n]) * self._inverses[: len(words) - n + 1])


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps until nothing changes.  Each step is
    a partial aggregate and a hash join on narrow rows, written to the shared
    folder; a hub is split by adaptive skew handling, as the hub's row is one and
    its links are many.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Edges that fall together are told apart once, after the second step.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u != v"), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        small = stage(small.where("u != v").distinct(), name)
        # Done when every node has one parent, and no parent has one itself.
        ends = small.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(small.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if open_.where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        edges = small
    roots = small.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def by_bytes(rows: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices whose text column holds at most ``limit`` bytes (or one row)."""
    for batch in rows:
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(name)).to_pylist()], np.int64)
        start = size = 0
        for at, n in enumerate(sizes):
            if at > start and size + n > limit:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def bucket_bits(spark_rows: DataFrame, column: str, bytes_per_bucket: int = 8 << 20) -> int:
    """So many bits of a hash that a bucket holds about ``bytes_per_bucket`` of text."""
    total = spark_rows.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0
    return max(4, min(24, (total // bytes_per_bucket).bit_length()))


def hidden(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns under names that clash with none; all may be null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {"doc_id": "doc_id", "text": "text"} | {c: f"_extra{i}" for i, c in enumerate(others)}
    # Work rows travel between documents and hold nulls, so no column may forbid them.
    return docs.select(*(F.when(F.lit(True), F.col(f"`{c}`")).alias(n) for c, n in names.items()))


def shown(found: DataFrame, docs: DataFrame, new: list[str]) -> DataFrame:
    """The columns of ``docs`` under their own names again, then the new ones, which replace any of the same name."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = {c: F.col(f"_extra{i}").alias(c) for i, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    return found.select(*(back[c] for c in docs.columns if c not in new), *new)
