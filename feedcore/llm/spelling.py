"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

A word is a point: how often it has each letter.  One edit moves a point by at most two
(L1): a replaced letter takes one count up and one down, an inserted letter one up.
Counts are held as unary bits, so a split plane is a bit, the box of a node is
the bits that all and that any of its points have, and the distance to a box is
a count of bits.  There is a tree a length; a word looks in the tree of its own
length and in that of the next.  What a range search finds is checked letter by letter.

The upper levels of the trees, planned from a bounded sample, deal all words out to
regions (a task's work); a word is sent to the regions its ball reaches.  A region
builds its own tree below.  Counting comes before any of this, so a word that makes
a third of all text is one row here.

Nulls: a null text has no words.  A null ``doc_id`` draws as the text ``null``.  Repeated
rows count once each.  Words of any length take part.  Ties of counts go to the smaller
word.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import batch_of, stage

#: Unary bits: ``LEVELS`` for each of ``DIMS`` letters.  Letters beyond a-z share six places; larger counts
#: are cut.  Either can only bring points nearer, so no neighbour is missed.
DIMS, LEVELS = 32, 4
BITS = DIMS * LEVELS
_PLACE = np.arange(256) % (DIMS - 26) + 26
_PLACE[97:123] = np.arange(26)

#: Words of a region, about, and words of a length from which its planes are planned.
REGION = 1 << 14
SAMPLE = 1 << 15
#: Points of a leaf, and queries that descend at once.
LEAF = 32
QUERIES = 2048


# ---------------------------------------------------------------- words and counts


def lowered(word: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_ = F.octet_length(word) == F.char_length(word)
    return F.when(ascii_, F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def runs(docs: DataFrame, least: int = 5) -> DataFrame:
    """``(doc_id, run)``: every maximal run of Latin letters of at least ``least`` code points, lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))


def misspelt(found: DataFrame, every: int) -> Column:
    """The run, with one letter left out where the hash of document and run says so."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.crc32(F.concat(key, F.lit(":"), F.col("run")))
    at = (drawn % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return F.when(drawn % every == 0, short).otherwise(F.col("run"))


def count_words(found: DataFrame, word: Column, least: int = 5, times: int = 3) -> DataFrame:
    """``(word, n)`` of words with ``least`` code points or more that occur ``times`` times or more."""
    words = found.select(word.alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


# ---------------------------------------------------------------- points


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def points(rows: np.ndarray) -> np.ndarray:
    """Unary letter counts: two 64-bit numbers a word."""
    counts = np.zeros((len(rows), DIMS), np.uint16)
    each = np.arange(len(rows))
    for column in rows.T:
        counts[each, _PLACE[column]] += 1
    unary = counts[:, :, None] > np.arange(LEVELS, dtype=np.uint16)
    return np.packbits(unary.reshape(len(rows), BITS), axis=1, bitorder="little").view("<u8")


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")


def has(codes: np.ndarray, bit: np.ndarray) -> np.ndarray:
    own = codes[np.arange(len(codes)), bit >> 6]
    return (own >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def beyond(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits of ``a`` are missing in ``b``."""
    return np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)


# ---------------------------------------------------------------- regions


def planes(sample: list[str], parts: int) -> list[tuple[int, int, int]]:
    """Upper levels of a tree: ``(bit, without, with)`` a node; a leaf is ``(-1, region, 0)``."""
    nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]
    bits = bits_of(points(letters([w.encode("latin-1") for w in sample]))).astype(bool)
    regions, open_ = 0, [(0, np.arange(len(sample)), parts)]
    while open_:
        node, own, share = open_.pop()
        sums = bits[own].sum(axis=0) if share > 1 else np.zeros(BITS)
        bit = int(np.argmin(np.abs(sums * 2 - len(own))))
        if not 0 < sums[bit] < len(own):
            nodes[node] = (-1, regions, 0)
            regions += 1
            continue
        nodes[node] = (bit, len(nodes), len(nodes) + 1)
        side = bits[own, bit]
        for part in (own[~side], own[side]):
            open_.append((len(nodes), part, max(1, round(share * len(part) / len(own)))))
            nodes.append((-1, 0, 0))
    return nodes


def reached(nodes: np.ndarray, codes: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, region, own)``: the regions a ball reaches, and which of them the point is in.

    ``up`` and ``down`` are how many bits a neighbour may have more and less.
    """
    query = np.arange(len(codes))
    at, ups, downs = np.zeros(len(codes), np.int64), np.full(len(codes), up), np.full(len(codes), down)
    done = []
    while len(query):
        bit, without, with_ = nodes[at].T
        leaf = bit < 0
        done.append((query[leaf], without[leaf], (ups[leaf] == up) & (downs[leaf] == down)))
        query, bit, without, with_, ups, downs = (x[~leaf] for x in (query, bit, without, with_, ups, downs))
        own = has(codes[query], bit)
        near, far = np.where(own, with_, without), np.where(own, without, with_)
        cross = np.where(own, downs, ups) > 0
        up_left, down_left = (ups - ~own)[cross], (downs - own)[cross]
        at = np.concatenate((near, far[cross]))
        query = np.concatenate((query, query[cross]))
        ups, downs = np.concatenate((ups, up_left)), np.concatenate((downs, down_left))
    return tuple(np.concatenate(x) for x in zip(*done))


OWN, SAME, SHORTER = 0, 1, 2
_SENT = pa.schema([("length", pa.int32()), ("region", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
SENT = "length int, region long, role byte, word string, n long"


def dealt(words: DataFrame, trees: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """Each word to its region, to later regions of its length and to regions of the next length."""

    def run(rows):
        own = {n: np.array(nodes, np.int64) for n, nodes in trees.items()}
        for batch in rows:
            names = np.array(batch.column("word").to_pylist(), object)
            counts = np.array(batch.column("n").to_pylist(), np.int64)
            sizes = np.array([len(w) for w in names], np.int64)
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                codes = points(letters([w.encode("latin-1") for w in names[some]]))
                query, region, home = reached(own[size], codes, 1, 1)
                homes = np.zeros(len(some), np.int64)
                homes[query[home]] = region[home]
                later = region >= homes[query]
                role = np.where(region == homes[query], OWN, SAME)
                yield _sent(size, region[later], role[later], names[some[query[later]]], counts[some[query[later]]])
                if size + 1 in own:
                    query, region, _ = reached(own[size + 1], codes, 1, 0)
                    yield _sent(size + 1, region, np.full(len(region), SHORTER), names[some[query]], counts[some[query]])

    return words.select("word", "n").mapInArrow(run, SENT)


def _sent(size: int, region, role, names, counts) -> pa.RecordBatch:
    return batch_of(_SENT, np.full(len(region), size, np.int32), region, role.astype(np.int8), names.tolist(), counts)


# ---------------------------------------------------------------- a region's tree


class Tree:
    """K-d tree over the points of a region; boxes are the bits of all and of any point."""

    def __init__(self, codes: np.ndarray) -> None:
        bits = bits_of(codes).astype(bool)
        order, nodes, open_ = [], [], [(np.arange(len(codes)), -1)]
        self.codes = codes
        filled = 0
        while open_:
            own, parent = open_.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][2].append(node)
            some = codes[own]
            nodes.append([np.bitwise_and.reduce(some), np.bitwise_or.reduce(some), [], filled, 0])
            sums = bits[own].sum(axis=0)
            bit = int(np.argmin(np.abs(sums * 2 - len(own))))
            if len(own) > LEAF and 0 < sums[bit] < len(own):
                side = bits[own, bit]
                open_ += [(own[side], node), (own[~side], node)]
            else:
                order.append(own)
                filled += len(own)
                nodes[node][4] = len(own)
        self.order = np.concatenate(order)
        self.all, self.any = (np.array([n[i] for n in nodes]) for i in (0, 1))
        self.children = np.array([n[2] or (-1, -1) for n in nodes], np.int64)
        self.first, self.size = (np.array([n[i] for n in nodes], np.int64) for i in (3, 4))

    def within(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(query, point)`` at most ``up`` bits up and ``down`` bits down, some queries at a time."""
        for start in range(0, len(queries), QUERIES):
            some = queries[start : start + QUERIES]
            query, node = np.arange(len(some)), np.zeros(len(some), np.int64)
            while len(query):
                own = some[query]
                inside = (beyond(own, self.any[node]) <= down) & (beyond(self.all[node], own) <= up)
                query, node = query[inside], node[inside]
                leaf = self.children[node, 0] < 0
                sizes = self.size[node[leaf]]
                if len(sizes):
                    left = np.repeat(query[leaf], sizes)
                    place = np.arange(len(left)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    right = self.order[np.repeat(self.first[node[leaf]], sizes) + place]
                    a, b = some[left], self.codes[right]
                    near = (beyond(a, b) <= down) & (beyond(b, a) <= up)
                    yield start + left[near], right[near]
                query = np.repeat(query[~leaf], 2)
                node = self.children[node[~leaf]].ravel()


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows ``b``, one longer, that are ``a`` with one letter put in."""
    from_left = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    from_right = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return from_left + from_right >= a.shape[1]


def near_pairs(own: np.ndarray, same: np.ndarray, shorter: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(role, query, point)`` of words one edit apart; pairs of the region's own words once."""
    tree = Tree(points(own))
    for role, rows, up, down, check in ((OWN, own, 1, 1, replaced), (SAME, same, 1, 1, replaced), (SHORTER, shorter, 1, 0, inserted)):
        if not len(rows):
            continue
        for query, point in tree.within(tree.codes if role == OWN else points(rows), up, down):
            if role == OWN:
                once = query < point
                query, point = query[once], point[once]
            good = check(rows[query], own[point])
            yield role, query[good], point[good]


NEAR = "word string, n_near long, near_n long, near string"
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def neighbours(words: DataFrame, trees: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """Per word and region: how many words are near, and the one of largest n (ties: the smallest)."""

    def search(table: pa.Table) -> pa.Table:
        role = np.array(table.column("role").to_pylist(), np.int8)
        names = np.array(table.column("word").to_pylist(), object)
        counts = np.array(table.column("n").to_pylist(), np.int64)
        parts = [np.flatnonzero(role == r) for r in (OWN, SAME, SHORTER)]
        if not len(parts[OWN]):
            return _NEAR.empty_table()
        rows = [letters([w.encode("latin-1") for w in names[p]]) if len(p) else np.empty((0, 0), np.uint8) for p in parts]
        total = np.zeros(len(names), np.int64)
        best = np.full(len(names), -1)
        place = np.empty(len(names), np.int64)
        place[np.lexsort((names.astype(str), -counts))] = np.arange(len(names))
        by_place = np.argsort(place)
        least = np.full(len(names), len(names))
        for r, query, point in near_pairs(*rows):
            a, b = parts[r][query], parts[OWN][point]
            for x, y in ((a, b), (b, a)):
                np.add.at(total, x, 1)
                np.minimum.at(least, x, place[y])
        some = np.flatnonzero(total)
        best = by_place[least[some]]
        columns = (names[some].tolist(), total[some], counts[best], names[best].tolist())
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)

    sent = dealt(words, trees)
    found = sent.groupBy("length", "region").applyInArrow(search, NEAR)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return found.select("word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near").alias("near"))


def plan_trees(words: DataFrame, region: int = REGION, sample: int = SAMPLE) -> dict[int, list[tuple[int, int, int]]]:
    """A tree a length.  To the driver: one row a length, and about ``sample`` words of each."""
    size = F.char_length("word")
    counts = {r.size: r.n for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    large = {n: c for n, c in counts.items() if c > region}
    trees = {n: [(-1, 0, 0)] for n in counts}
    if large:
        share = F.lit(0)
        for n, c in large.items():
            share = F.when(size == n, int(min(1.0, sample / c) * (1 << 30))).otherwise(share)
        rows = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share).select("word").collect()
        for n, c in large.items():
            trees[n] = planes(sorted(r.word for r in rows if len(r.word) == n), -(-c // region))
    return trees


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: follow forms to the last, twice as far in each round."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stage(step, "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def groups(words: DataFrame, ratio: int = 2, region: int = REGION) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words(word, n)``, each word once.

    A form is the near word of largest n, if that is at least ``ratio`` (more than 1) times the word's own.
    Words are texts of Latin-1 characters.
    """
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = neighbours(words, plan_trees(words, region))
    known = words.join(near, "word", "left")
    taken = F.col("near_n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("near")).alias("form"),
                         F.when(taken, F.col("near_n")).alias("form_n"))
    known = stage(known, "forms")
    last = roots(known.where("form is not null"))
    named = known.join(last, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
