"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Sets are put into bands of like size.  Two sets of a band (or of two neighbouring
bands) with similarity ``num/den`` or more differ in at most ``H`` shingles, ``H``
from the band's largest size.  A hash deals the universe into ``H + 1`` segments, so
two such sets agree on at least one segment (pigeonhole).  Each set is indexed under
the hash of each of its segment subsets.

Thresholds are allocated by cost.  A segment costs its posting list, and the list of
the empty subset would hold a share of all sets: an empty segment gets threshold -1
(it is not indexed), and segments that can make up for it get +1: their
one-deletion neighbourhoods are indexed as well.  The raised ones are the shortest
prefix of the band's segments in which ``e`` have two shingles or more, ``e`` being
the number of empty ones.  All others keep threshold 0.

Why no pair is lost: let two similar sets agree on no non-empty segment, and let
``a >= 1`` be the segments empty in both.  The others differ by one at least.  In the
shorter of both prefixes at least ``a`` segments have two shingles or more in one
set; where no deletion meets the other set's subset they differ by two at least.
That makes ``(H + 1 - a) + a > H`` differences.  Sets without such a prefix raise
all segments and are indexed under one key of their own, for pairs of two of them.

A common key says little of long tables: unrelated texts share a common phrase that is alone in its
segment.  So the members of all sets with a common key are counted.  A set that has a partner has
``num/den`` of its members in common with it: a set with fewer members that occur twice goes.  The
others meet by their rarest members: two similar sets share one of the first
``n - least joint + 1`` members of either, in any order that all sets keep.

Candidates are not listed pairwise.  In a member's list each set meets one leader (first
within a task, then over all tasks); links are verified and contracted.  Sets that
hang together by rare members but not by links are then compared in full, in blocks, and
only links come out.  Sets that are equal count as one.

Words are runs without ASCII white space, A-Z lower-cased.  Nulls: a null text has no
words; texts without words are linked with nothing.  A null ``doc_id`` takes part and
is never the smallest unless all of its class are null.  Repeated rows are one class.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import Rolling, as_bytes, bucket_bits, by_bytes, components, mixed, stage, text_key, word_hashes

_SHINGLES = Rolling(0x9E3779B97F4A7C15)
_POST = np.dtype([("key", "<u8"), ("node", "S16")])
BATCH_BYTES, PART_BYTES = 8 << 20, 1 << 20
#: Text behind the sets that are kept and counted together.
HELD_BYTES = 2 << 20
#: Members that are counted in one task.
COUNTED = 2 << 20
#: Members that a round of comparisons may move, however few the sets hold.
ROUND = 1 << 24


@dataclass(frozen=True)
class Likeness:
    """Similar means ``den * |intersection| >= num * |union|`` of sets of ``words``-word shingles."""

    words: int = 5
    num: int = 4
    den: int = 5

    def similar(self, joint: int, a: int, b: int) -> bool:
        return self.den * joint >= self.num * (a + b - joint)

    def bands(self, largest: int) -> np.ndarray:
        """Largest size of each band; a set has partners in its band and the next ones to it only."""
        tops = [0, 1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, tops[-1] * self.den // self.num))
        return np.array([*tops, max(tops[-1] + 1, tops[-1] * self.den // self.num)], np.int64)

    def segments(self, top: np.ndarray) -> np.ndarray:
        return 2 * top * (self.den - self.num) // (self.den + self.num) + 1


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; fewer words than a shingle make one."""
    hashes, sizes = word_hashes(texts, lower=True)
    ends = np.cumsum(sizes)
    every = _SHINGLES.windows(hashes, words)
    out = []
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        if end - start >= words:
            out.append(np.unique(every[start : end - words + 1]))
        else:
            out.append(_SHINGLES.windows(hashes[start:end], end - start) if end > start else hashes[:0])
    return out


def node_of(own: np.ndarray) -> bytes:
    """128 bits that stand for a set.  They end in a set bit, as numpy drops closing zeros."""
    name = bytearray(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
    name[-1] |= 1
    return bytes(name)


def signatures(sets: list[np.ndarray], like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which sets are indexed: ``(which set, key)``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sets) or not sizes.max():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    tops = like.bands(int(sizes.max()))
    band = np.searchsorted(tops, sizes)
    which, group = [], []
    for step in (0, 1):
        g = band + step
        joins = (sizes > 0) & (sizes * like.den >= like.num * (tops[g - 1] + 1)) & (like.segments(tops[g]) > 1)
        which.append(np.flatnonzero(joins))
        group.append(g[joins])
    which, group = np.concatenate(which), np.concatenate(group)
    if not len(which):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    m = like.segments(tops[group])
    first = np.cumsum(m) - m
    length = sizes[which]
    values = np.concatenate([sets[w] for w in which])
    entry = np.repeat(np.arange(len(which)), length)
    seed = mixed(group.astype(np.uint64), 5)
    part = first[entry] + (mixed(values ^ seed[entry], 1) % m[entry].astype(np.uint64)).astype(np.int64)
    own = mixed(values, 2)
    with np.errstate(over="ignore"):
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, part, own)
        counts = np.bincount(part, minlength=len(sums))
        owner = np.repeat(np.arange(len(which)), m)
        place = np.arange(len(sums)) - first[owner]
        tag = mixed(group.astype(np.uint64), 9)[owner] + mixed(place.astype(np.uint64), 4)
        full = counts > 0
        out_which, out_key = [which[owner[full]]], [mixed(sums[full] ^ tag[full], 6)]
        empty = np.add.reduceat((counts == 0).astype(np.int64), first)
        big = (counts >= 2).astype(np.int64)
        before = np.cumsum(big) - big
        before -= before[first][owner]
        raised = before < empty[owner]
        chosen = raised[part] & (counts[part] >= 2)
        out_which.append(which[entry[chosen]])
        out_key.append(mixed((sums[part[chosen]] - own[chosen]) ^ tag[part[chosen]], 6))
    short = np.add.reduceat(big, first) < empty
    out_which.append(which[short])
    out_key.append(mixed(seed[short], 8))
    which, key = np.concatenate(out_which), np.concatenate(out_key)
    # One entry where both bands or a deletion gave the same key.
    order = np.lexsort((key, which))
    which, key = which[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (which[1:] != which[:-1]) | (key[1:] != key[:-1])
    return which[new], key[new]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the run of equal keys that each place lies in, and the starts; keys are sorted."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    return starts[np.cumsum(new) - 1] if len(keys) else starts, starts


def stars(posts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set against the least set of its key: the least posts by key, and pairs (less, more)."""
    posts = posts[np.argsort(posts["key"])]
    same = posts["key"][1:] == posts["key"][:-1]
    shared = np.zeros(len(posts), bool)
    shared[1:] |= same
    shared[:-1] |= same
    own = np.unique(posts[shared])
    lead, starts = runs(own["key"])
    rest = np.flatnonzero(lead != np.arange(len(own)))
    pairs = np.empty((0, 2), "S16")
    if len(rest):
        pairs = np.unique(np.stack([own["node"][lead[rest]], own["node"][rest]], 1).view("S32")).view("S16").reshape(-1, 2)
    least = np.concatenate((posts[~shared], own[starts]))
    return least[np.argsort(least["key"])], pairs


def packed(posts: np.ndarray, bits: int) -> bytes:
    """Posts of one bucket: its nodes once, then 48 bits of each key behind the bucket's, then places of nodes.

    Keys that fall together only bring candidates that are checked later.
    """
    nodes, place = np.unique(posts["node"], return_inverse=True)
    keys = (posts["key"] << np.uint64(bits) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    small = np.uint16 if len(nodes) <= 1 << 16 else np.uint32
    head = np.array([len(posts), len(nodes)], "<u4")
    return head.tobytes() + nodes.astype("S16").tobytes() + keys.tobytes() + place.astype(small).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, _POST)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    posts, keys = np.empty(n, _POST), np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 8 + 16 * m).reshape(n, 6)
    place = np.frombuffer(data, np.uint16 if m <= 1 << 16 else np.uint32, n, 8 + 16 * m + 6 * n)
    posts["key"], posts["node"] = keys.view("<u8").ravel(), np.frombuffer(data, "S16", m, 8)[place]
    return posts


def _nodes(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.binary())


_ROW = "kind string, doc_id long, n_shingles long, a binary, b binary, key binary"


def index(docs: DataFrame, like: Likeness, bits: int) -> DataFrame:
    """Staged rows: ``doc`` (its set's node ``a`` and text key), ``pair`` (candidates ``a``, ``b``).

    One shuffle carries the postings; documents' own rows travel along as blobs.
    """
    id_type = pa.int64()

    def post(rows):
        for turn, batch in enumerate(by_bytes(rows, "text", BATCH_BYTES)):
            nodes, sizes, met, posts = [], [], set(), []
            # What is worked on is many times a text, so it is a part of the batch.
            for part in by_bytes([batch], "text", PART_BYTES):
                sets = shingle_sets(as_bytes(part, "text"), like.words)
                own = [node_of(s) for s in sets]
                distinct = {n: s for n, s in zip(own, sets) if len(s) and n not in met}
                which, keys = signatures(list(distinct.values()), like)
                posts.append(np.empty(len(keys), _POST))
                posts[-1]["key"], posts[-1]["node"] = keys, np.array([*distinct, b""], "S16")[which]
                met.update(distinct)
                nodes += own
                sizes += [len(s) for s in sets]
            posts = np.concatenate(posts)
            least, pairs = stars(posts)
            blobs = blobs_of(least, bits)
            sink = pa.BufferOutputStream()
            table = pa.record_batch(
                [batch.column("doc_id").cast(id_type), pa.array(sizes, id_type), pa.array(nodes, pa.binary()), batch.column("key")],
                ["doc_id", "n_shingles", "a", "key"],
            )
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            named = [n for n, size in zip(nodes, sizes) if size]
            home = (named[0][0] if named else turn) % (1 << bits)
            blobs.append((home, b""))
            n = len(blobs)
            yield pa.record_batch(
                [
                    pa.array([b for b, _ in blobs], pa.int32()),
                    pa.array([p for _, p in blobs], pa.binary()),
                    pa.array([None] * (n - 1) + [sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([None] * (n - 1) + [pairs.tobytes()], pa.binary()),
                ],
                ["bucket", "posts", "docs", "pairs"],
            )

    def meet(table: pa.Table) -> pa.Table:
        out = []
        schema = pa.schema([("kind", pa.string()), ("doc_id", id_type), ("n_shingles", id_type), ("a", pa.binary()), ("b", pa.binary()), ("key", pa.binary())])

        def add(kind, n, **columns):
            if n:
                columns["kind"] = pa.array([kind] * n)
                out.append(pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema))

        posts = np.concatenate([unpacked(x) for x in table.column("posts").to_pylist()])
        pairs = [stars(posts)[1]]
        for data, local in zip(table.column("docs").to_pylist(), table.column("pairs").to_pylist()):
            if data is not None:
                with pa.ipc.open_stream(data) as reader:
                    own = reader.read_next_batch()
                add("doc", own.num_rows, **{c: own.column(c) for c in own.schema.names})
                pairs.append(np.frombuffer(local, "S16").reshape(-1, 2))
        pairs = np.unique(np.concatenate(pairs).view("S32")).view("S16").reshape(-1, 2)
        add("pair", len(pairs), a=_nodes(pairs[:, 0]), b=_nodes(pairs[:, 1]))
        return pa.concat_tables(out) if out else schema.empty_table()

    keyed = docs.select("doc_id", "text", text_key("text").alias("key"))
    sent = keyed.mapInArrow(post, "bucket int, posts binary, docs binary, pairs binary")
    return stage(sent.groupBy("bucket").applyInArrow(meet, _ROW), "index")


def blobs_of(posts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """``(bucket, its posts)`` of posts in the order of their keys."""
    order = (posts["key"] >> np.uint64(64 - bits)).astype(np.int64)
    filled, starts = np.unique(order, return_index=True)
    ends = [*starts[1:].tolist(), len(order)]
    return [(b, packed(posts[i:j], bits)) for b, i, j in zip(filled.tolist(), starts.tolist(), ends)]


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(name, nodes, sizes, members)``: the sets of the wanted nodes, many in a row that its first node names.

    Their texts are read again and shingled.
    """

    def run(rows):
        for batch in by_bytes(rows, "text", HELD_BYTES):
            sets, nodes = shingle_sets(as_bytes(batch, "text"), words), batch.column("node").to_pylist()
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.record_batch(
                [pa.array([x], pa.binary()) for x in (nodes[0], b"".join(nodes), sizes.tobytes(), np.concatenate(sets).tobytes())],
                ["name", "nodes", "sizes", "members"],
            )

    texts = docs.select("doc_id", "text", text_key("text").alias("key"))
    # One row a node: its least document.  Repeated rows of that document fall to one.
    one = texts.join(wanted, [texts.doc_id.eqNullSafe(wanted.of_doc), texts.key == wanted.of_key])
    found = one.select("node", "text").dropDuplicates(["node"])
    return found.mapInArrow(run, "name binary, nodes binary, sizes binary, members binary")


def counts_of(held: DataFrame, bits: int) -> DataFrame:
    """``(name, bucket, counts)``: in how many sets the members of a row of ``sets_of`` occur, 255 at most.

    Distinct members of a row in ascending order, cut by their first ``bits`` bits, have a byte each.  A member travels
    as the 40 bits behind these; members that fall together have one count, of both.
    """

    def send(rows):
        for batch in rows:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("members")):
                values, times = np.unique(np.frombuffer(data.as_buffer(), np.uint64), return_counts=True)
                ends = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                keys = (values << np.uint64(bits) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                times = np.minimum(times, 255).astype(np.uint8)
                filled = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                yield pa.record_batch(
                    [
                        pa.array(filled, pa.int32()),
                        pa.array([name] * len(filled), pa.binary()),
                        pa.array([keys[ends[b] : ends[b + 1]].tobytes() for b in filled], pa.binary()),
                        pa.array([times[ends[b] : ends[b + 1]].tobytes() for b in filled], pa.binary()),
                    ],
                    ["bucket", "name", "keys", "times"],
                )

    def count(table: pa.Table) -> pa.Table:
        times = [np.frombuffer(x, np.uint8) for x in table.column("times").to_pylist()]
        ends = np.cumsum([len(x) for x in times]).tolist()
        keys = np.zeros((ends[-1], 8), np.uint8)
        for data, own, end in zip(table.column("keys").to_pylist(), times, ends):
            keys[end - len(own) : end, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
        keys = keys.view("<u8").ravel()
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.minimum(np.add.reduceat(np.concatenate(times)[order], starts, dtype=np.int64), 255).astype(np.uint8)
        total = np.empty(len(order), np.uint8)
        total[order] = np.repeat(sums, np.diff(starts, append=len(order)))
        counts = [total[end - len(own) : end].tobytes() for own, end in zip(times, ends)]
        return pa.table({"name": table.column("name"), "bucket": table.column("bucket"), "counts": pa.array(counts, pa.binary())})

    sent = held.mapInArrow(send, "bucket int, name binary, keys binary, times binary")
    return sent.groupBy("bucket").applyInArrow(count, "name binary, bucket int, counts binary")


def rarest(flat: np.ndarray, sizes: np.ndarray, counts: np.ndarray, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """``(set, member)`` by which sets meet: members that occur twice or more among the first of each set by count.

    ``flat`` holds the members of all sets one behind the other, ``counts`` in how many sets each occurs.  Sets
    too few of whose members occur twice have none.
    """
    least = -(-like.num * sizes // like.den)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    some = np.bincount(owner[counts > 1], minlength=len(sizes)) >= least
    flat, counts, owner = flat[some[owner]], counts[some[owner]], owner[some[owner]]
    order = np.lexsort((flat, counts, owner))
    held = np.where(some, sizes, 0)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)
    first = order[(place < (sizes - least + 1)[owner]) & (counts[order] > 1)]
    return owner[first], flat[first]


def met(held: DataFrame, bits: int, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """``(node, size, members)`` of sets that may have a partner, and pairs ``(a, b)`` that share a rare member."""

    def choose(_, sets: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        counts = counted.sort_by("bucket").column("counts").to_pylist()
        for nodes, sizes, data in zip(*(sets.column(c).to_pylist() for c in ("nodes", "sizes", "members"))):
            nodes, sizes, flat = np.frombuffer(nodes, "S16"), np.frombuffer(sizes, np.int64), np.frombuffer(data, np.uint64)
            place = np.unique(flat, return_inverse=True)[1]
            which, keys = rarest(flat, sizes, np.frombuffer(b"".join(counts), np.uint8)[place], like)
            posts = np.empty(len(keys), _POST)
            posts["key"], posts["node"] = keys, nodes[which]
            least, pairs = stars(posts)
            ends = np.cumsum(sizes)
            for w in np.unique(which).tolist():
                own = flat[ends[w] - sizes[w] : ends[w]]
                out.append({"node": nodes[w], "size": len(own), "members": own.tobytes()})
            for turn, (b, blob) in enumerate(blobs_of(least, bits)):
                out.append({"bucket": b, "posts": blob, "pairs": b"" if turn else pairs.tobytes()})
        return pa.Table.from_pylist(out, schema)

    def meet(table: pa.Table) -> pa.Table:
        posts = np.concatenate([unpacked(x) for x in table.column("posts").to_pylist()])
        pairs = [stars(posts)[1], *(np.frombuffer(x, "S16").reshape(-1, 2) for x in table.column("pairs").to_pylist())]
        pairs = np.unique(np.concatenate(pairs).view("S32")).view("S16").reshape(-1, 2)
        return pa.table({"a": _nodes(pairs[:, 0]), "b": _nodes(pairs[:, 1])})

    schema = pa.schema(
        [("node", pa.binary()), ("size", pa.int64()), ("members", pa.binary()), ("bucket", pa.int32()), ("posts", pa.binary()), ("pairs", pa.binary())]
    )
    both = held.groupBy("name").cogroup(counts_of(held, bits).groupBy("name"))
    row = "node binary, size long, members binary, bucket int, posts binary, pairs binary"
    chosen = stage(both.applyInArrow(choose, row), "sets")
    sent = chosen.where("node is null").select("bucket", "posts", "pairs")
    pairs = stage(sent.groupBy("bucket").applyInArrow(meet, "a binary, b binary").distinct(), "pairs")
    return chosen.where("node is not null").select("node", "size", "members"), pairs


def verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs ``(a, b)`` whose sets are similar, by their members."""

    def run(rows):
        for batch in rows:
            a, b = batch.column("a"), batch.column("b")
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                good.append(like.similar(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"), F.col("size").alias("nx"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"), F.col("size").alias("ny"))
    # Sizes alone rule many pairs out, before any members move.
    sized = pairs.join(left.drop("x"), "a").join(right.drop("y"), "b")
    fits = F.least("nx", "ny") * like.den >= F.greatest("nx", "ny") * like.num
    close = sized.where(fits).select("a", "b")
    return close.join(left.drop("nx"), "a").join(right.drop("ny"), "b").mapInArrow(run, "a binary, b binary")


class Cell:
    """Sets compared within a task: by their rarest members, then exactly.

    Two similar sets share one of the first ``n - least joint + 1`` members of either, in any order that
    all sets keep; here the rarest of the cell come first, so few pairs are looked at.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, parts: np.ndarray, like: Likeness) -> None:
        """``flat`` holds the members of all sets one behind the other."""
        self.like, self.parts = like, parts.copy()
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        values, counts = np.unique(flat, return_counts=True)
        rarity = np.empty(len(counts), np.int32)
        rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        self.flat, self.once = np.empty(len(flat), np.int32), int((counts == 1).sum())
        for at in range(0, len(flat), 1 << 18):
            self.flat[at : at + (1 << 18)] = rarity[np.searchsorted(values, flat[at : at + (1 << 18)])]
        self.mark = np.zeros(len(counts), bool)

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """``(member, set)`` of all prefixes, by member; members of one set only are left out."""
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        order = np.lexsort((self.flat, owner))
        # Sets stay one behind the other; only the members of each are in order.
        least = -(-self.like.num * self.sizes // self.like.den)
        prefix = self.sizes - least + 1
        starts = np.repeat(self.ends - self.sizes, prefix) + np.arange(int(prefix.sum())) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        first = order[starts]
        del order
        first = first[self.flat[first] >= self.once]
        first = first[np.argsort(self.flat[first], kind="stable")]
        return self.flat[first], owner[first]

    def joined(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        """Similar pairs of different parts; the parts become one."""
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        starts = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))).tolist()
        for i, j in zip(starts, [*starts[1:], len(left)]):
            x, others = int(left[i]), right[i:j]
            others = others[self.parts[others] != self.parts[x]]
            if not len(others):
                continue
            own = self.flat[self.ends[x] - self.sizes[x] : self.ends[x]]
            self.mark[own] = True
            sizes = self.sizes[others]
            firsts = np.cumsum(sizes) - sizes
            at = np.repeat(self.ends[others] - sizes - firsts, sizes) + np.arange(int(sizes.sum()))
            joint = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), firsts)
            self.mark[own] = False
            good = self.like.den * joint >= self.like.num * (sizes + len(own) - joint)
            for y in others[good].tolist():
                if self.parts[x] != self.parts[y]:
                    yield x, y
                    self.parts[self.parts == self.parts[y]] = self.parts[x]

    def links(self, held: int = 1 << 19) -> Iterator[tuple[int, int]]:
        """Pairs that join all parts that similarity joins; pairs are held ``held`` at a time."""
        member, owner = self.postings()
        owner = owner.astype(np.int64)
        at = np.arange(len(member))
        step, waiting, n = 0, [], 0
        while len(at):
            step += 1
            at = at[at + step < len(member)]
            at = at[member[at] == member[at + step]]
            x, y = owner[at], owner[at + step]
            small, large = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
            apart = (self.parts[x] != self.parts[y]) & (self.like.den * small >= self.like.num * large)
            waiting.append(np.unique(np.minimum(x, y)[apart] * len(self.sizes) + np.maximum(x, y)[apart]))
            n += len(waiting[-1])
            if n > held or not len(at):
                pairs = np.unique(np.concatenate(waiting))
                if len(pairs):
                    yield from self.joined(*np.divmod(pairs, len(self.sizes)))
                waiting, n = [], 0


def contracted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of components ``(a, b)`` that candidates of different components join."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias("own"))
        pairs = pairs.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cells(known: DataFrame, bands: np.ndarray, block: int) -> DataFrame:
    """``(node, own, size, family, i, j)``: the cells, pairs of blocks, that each set of ``known(node, own, family, size)`` goes to.

    Similar sets lie in one band of sizes or in two neighbouring ones.  A band of a family is cut into blocks of
    about ``block`` members; a block meets those of its own band and of the two beside it.  A family
    that fits one block is one cell.
    """
    tops = F.array(*(F.lit(int(t)) for t in bands))
    known = known.withColumn("band", F.size(F.filter(tops, lambda t: t < F.col("size"))))
    members = known.groupBy("family", "band").agg(F.sum("size").alias("members"))
    whole = members.groupBy("family").agg(F.sum("members").alias("whole"))
    level = F.when(F.col("whole") <= block, 0).otherwise(F.col("band"))
    levels = members.join(whole, "family").withColumn("level", level)
    sizes = levels.groupBy("family", "level").agg(F.ceil(F.sum("members") / block).cast("int").alias("blocks"))
    beside = sizes.select("family", F.explode(F.array(*(F.col("level") + d for d in (-1, 0, 1)))).alias("level"), F.col("level").alias("other"), F.col("blocks").alias("others"))
    # A block that meets others is compared with itself there.
    around = beside.groupBy("family", "level").agg(F.collect_list(F.struct("other", "others")).alias("beside"), F.sum("others").alias("around"))
    levels = levels.select("family", "band", "level").join(sizes, ["family", "level"]).join(around, ["family", "level"])
    dealt = known.join(levels, ["family", "band"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.select("*", F.inline("beside"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("next"))
    name = [F.shiftleft(F.col(of).cast("long"), 32) + F.col(n) for of, n in (("level", "mine"), ("other", "next"))]
    dealt = dealt.where((name[0] != name[1]) | (F.col("around") == 1))
    return dealt.select("node", "own", "size", "family", F.least(*name).alias("i"), F.greatest(*name).alias("j"))


def links_between(
    sets: DataFrame, near: DataFrame, roots: DataFrame, like: Likeness, block: int = 3 << 19, least_round: int = ROUND
) -> DataFrame:
    """Links ``(a, b)`` between components, exactly: what one leader each could not tell.

    A family is what hangs together by shared keys: components and the ``near`` pairs
    of them.  Families are compared in full, block by block: a set goes to as many tasks as there are
    blocks of sets of like size in its family.  Inside a task sets meet by their rarest members.  Only
    links that join components come out, fewer than there are components in the two blocks.

    A set's copies would take many times its own disk, so cells are compared in rounds.  Each moves about as
    many members as all sets hold (or ``least_round``), and its files go when its links are written.
    """
    family = stage(components(near, "families").select(F.col("node").alias("own"), F.col("root").alias("family")), "families")
    # Places are found from names and sizes alone; members move twice a round, to their places and to their tasks.
    known = sets.select("node", "size").join(roots.withColumnRenamed("root", "own"), "node", "left")
    known = known.withColumn("own", F.coalesce("own", "node")).join(family, "own")
    largest, held = sets.agg(F.max("size"), F.sum("size")).first()
    placed = stage(cells(known, like.bands(largest or 0), block), "placed")
    moved = placed.agg(F.sum("size")).first()[0] or 0
    rounds = max(1, -(-moved // max(held or 0, least_round)))

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        number = {o: n for n, o in enumerate(dict.fromkeys(own))}
        found = []
        if len(number) > 1:
            members = table.column("members").combine_chunks()
            sizes = pc.binary_length(members).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            flat = np.frombuffer(b"".join(x.as_buffer() for x in members), np.uint64)
            cell = Cell(flat, sizes, np.array([number[o] for o in own]), like)
            found = [(own[x], own[y]) for x, y in cell.links()]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    def links(turn: int) -> DataFrame:
        mine = placed.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(rounds)) == turn).drop("size")
        dealt = sets.select("node", "members").join(mine, "node")
        return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a binary, b binary")

    return reduce(DataFrame.unionByName, [stage(links(turn), "round") for turn in range(rounds)])


def classes(docs: DataFrame, like: Likeness, keyed: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document.

    ``keyed`` gives ``(doc_id, key, n_shingles, root)`` instead, the text's key and the
    class's own name, which tell rows of one id apart.
    """
    bits = bucket_bits(docs, "text")
    indexed = index(docs, like, bits)
    of_docs = indexed.where("kind = 'doc'").select("doc_id", "n_shingles", "a", "key")
    pairs = indexed.where("kind = 'pair'").select("a", "b")
    ends = pairs.select("a").union(pairs.select("b")).distinct()
    one = of_docs.join(ends, "a", "left_semi").groupBy("a").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    wanted = one.select(F.col("a").alias("node"), F.col("least.doc_id").alias("of_doc"), F.col("least.key").alias("of_key"))
    held = stage(sets_of(docs, wanted, like.words), "held")
    members = (held.agg(F.sum(F.octet_length("members"))).first()[0] or 0) // 8
    sets, pairs = met(held, max(4, (members // COUNTED).bit_length()), like)
    links = stage(verified(pairs, sets, like), "links")
    roots = stage(components(links, "components"), "roots")
    near = stage(contracted(pairs, roots), "near")
    if not near.isEmpty():
        more = stage(links_between(sets, near, roots, like), "links")
        upper = components(more, "components")
        tops = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
        lone = upper.join(roots, "node", "left_anti")
        roots = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(lone)
        roots = stage(roots, "roots")
    named = of_docs.join(roots.withColumnRenamed("node", "a"), "a", "left")
    if keyed:
        return named.select("doc_id", "key", "n_shingles", F.coalesce("root", "a").alias("root"))
    named = named.select("doc_id", "n_shingles", F.coalesce("root", "a").alias("root"))
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = named.where("n_shingles > 0")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return some.join(least, "root").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def distinct_documents(docs: DataFrame, like: Likeness | None = None) -> DataFrame:
    """One document of each class: the one with the smallest ``doc_id``; all columns stay.

    Rows that repeat id and text are one document.  Rows of one id with different texts are
    documents of their own: the smaller text key is the smaller document.  Rows whose ``doc_id`` is null stay.
    """
    key = text_key("text")
    found = classes(docs.where("doc_id is not null").select("doc_id", "text"), like or Likeness(), keyed=True)
    least = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    gone = found.where("n_shingles > 0").join(least, "root").where("least.doc_id <> doc_id or least.key <> key")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), "doc_id", key.alias("own_key"))
    # The join and what follows share one shuffle of the texts.
    some = kept.where("doc_id is not null").join(gone, [F.col("doc_id") == F.col("gone_id"), F.col("own_key") == F.col("gone_key")], "left_anti")
    some = some.dropDuplicates(["doc_id", "own_key"]).unionByName(kept.where("doc_id is null"))
    return some.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
