"""Language of words and documents by a linear-chain conditional random field.

Words carry affix, n-gram and lexicon (whole word) features, hashed into one weight
table; neighbouring words share learned transitions.  Forward-backward gives every
word's label probabilities, so code-switched text keeps its parts apart.  A
document's language is the one with the largest share of words.

``learn`` fits the model on the whole texts of all learnable documents.  They are dealt by
hash of id and text to shards of about ``SHARD`` bytes; each shard fits weights of its own on
code-switched chains of its words, so that transitions can be learned, and a weight's mean
over the shards counts each by how often it met the feature.  Sums are kept in whole numbers,
so the model does not depend on how rows lie in partitions.  The weights (about 1 MB) go to
the tasks; prediction covers whole texts.  ``train`` fits rows in memory, ``sample`` gives some.

Nulls: a null or letterless text is ``und`` with score 0.  Rows without a label are
never learned from.  Without any label every text is ``und``.  Ties go to the label
that sorts first.  Repeated rows are rows of their own; an empty table gives no rows.
A long text is chains of 64 words, each decoded apart.  Extra columns are carried as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedcore.llm.common import by_bytes, clear_worker, text_key

UNKNOWN = "und"
BATCH_BYTES = 4 << 20
#: Bytes of a shard's texts that are strings at once.
READ_BYTES = 1 << 20
BUCKETS = 1 << 16
CHAIN = 64
#: Letters of a word at most: scripts without spaces write sentences as one run.
LONGEST = 40
#: Bytes of text that fit a shard, and steps a shard is fitted by (in ``EPOCHS`` passes at most).
SHARD, STEPS, EPOCHS = 8 << 20, 60, 6
#: Characters of a slice, of which shares of features are told.
SLICE = 2500
#: Weights are added up as whole multiples of this, in so many groups; shares of features as whole parts of ``BINS``.
GRAIN, GROUPS, BINS = 2.0**-20, 32, 1 << 16
_letters = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; longer ones are cut into pieces, so that all of a text is read."""
    return _letters(text.lower())


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, a bias, its affixes, its n-grams."""
    w = word.encode()
    n = len(w)
    keys = [b"w" + w, b"b"]
    keys += [b"p" + w[:k] for k in range(1, min(n, 4) + 1)] + [b"s" + w[-k:] for k in range(1, min(n, 4) + 1)]
    keys += [b"n" + w[i : i + k] for k in (2, 3) for i in range(n - k + 1)]
    return [zlib.crc32(k) % BUCKETS for k in keys]


_TABLE = np.array([i for i in range(256)], np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words, one list behind the other, and their sizes: checksums of all words' parts step by step."""
    coded = [w.encode() for w in words]
    n = np.array([len(w) for w in coded], np.int64)
    data = np.frombuffer(b"".join(coded), np.uint8)
    ends = np.cumsum(n)
    begin, short = ends - n, np.minimum(n, 4)
    sizes = 2 + 2 * short + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
    first = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.int64)

    def put(at: np.ndarray, state: np.ndarray) -> None:
        flat[at] = (state ^ np.uint32(0xFFFFFFFF)) % BUCKETS

    def after(state: np.ndarray | np.uint32, at: np.ndarray) -> np.ndarray:
        return _TABLE[(state ^ data[at]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))

    start = {k: np.uint32(zlib.crc32(k) ^ 0xFFFFFFFF) for k in (b"p", b"s", b"n")}
    flat[first] = np.fromiter((zlib.crc32(b"w" + w) % BUCKETS for w in coded), np.int64, len(coded))
    flat[first + 1] = zlib.crc32(b"b") % BUCKETS
    own, state = np.arange(len(coded)), start[b"p"]
    for k in range(1, 5):
        long = n[own] >= k
        own = own[long]
        state = after(state if k == 1 else state[long], begin[own] + k - 1)
        put(first[own] + 1 + k, state)
    for k in range(1, 5):
        own, state = np.flatnonzero(n >= k), start[b"s"]
        for i in range(k):
            state = after(state, ends[own] - k + i)
        put(first[own] + 1 + short[own] + k, state)
    place = np.arange(len(data)) - np.repeat(begin, n)
    left, grams = np.repeat(n, n) - place, np.repeat(first + 2 + 2 * short, n) + place
    at = np.flatnonzero(left >= 2)
    state = after(after(start[b"n"], at), at + 1)
    put(grams[at], state)
    longer = left[at] >= 3
    at = at[longer]
    put(grams[at] + (left + place - 1)[at], after(state[longer], at + 2))
    return flat, sizes


def forward_backward(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Label probabilities of chains ``emit[chain, time, label]`` (positive factors, not logs).

    Also the expected transitions and the log of the sums.  Rows behind a chain's end hold zeros.
    """
    n, steps, labels = emit.shape
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    log_sum = np.zeros(n)
    now = emit[:, 0] * start
    live = np.arange(steps)[None, :] < sizes[:, None]
    for t in range(steps):
        if t:
            now = np.where(live[:, t, None], (now @ move) * emit[:, t], now)
        total = now.sum(1, keepdims=True)
        now = now / total
        log_sum += np.where(live[:, t], np.log(total[:, 0]), 0)
        ahead[:, t] = now
    now = np.ones((n, labels), emit.dtype)
    for t in range(steps - 1, -1, -1):
        back[:, t] = now
        before = (now * emit[:, t]) @ move.T
        before /= np.maximum(before.sum(1, keepdims=True), 1e-30)
        now = np.where(live[:, t, None], before, now)
    marginals = ahead * back
    marginals /= np.maximum(marginals.sum(2, keepdims=True), 1e-30)
    marginals *= live[:, :, None]
    return marginals, ahead, back, log_sum, live


class Model:
    """Labels, feature weights, transitions; predicts texts."""

    limit = 500_000

    def __init__(self, labels: list[str], weights: np.ndarray, move: np.ndarray, start: np.ndarray, usual: np.ndarray) -> None:
        self.labels, self.weights, self.move, self.start, self.usual = labels, weights, move, start, usual

    def __getstate__(self):
        return self.labels, self.weights, self.move, self.start, self.usual

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Factors of each label, and the share of a word's affixes and n-grams that are usual in some language."""
        flat, sizes = features_of(words)
        starts = np.cumsum(sizes) - sizes
        scores = np.add.reduceat(self.weights[flat], starts, axis=0)
        usual = self.usual[flat]
        # The first two features are the whole word and the bias.
        usual[starts] = usual[starts + 1] = False
        familiar = np.add.reduceat(usual.astype(np.float32), starts) / (sizes - 2)
        return np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0)).astype(np.float32), familiar

    def _known(self, words: set[str]) -> None:
        if not hasattr(self, "rows") or len(self.rows) > self.limit:
            self.rows, self.table, self.used = {}, np.zeros((1 << 16, len(self.labels) + 1), np.float32), 0
        new = [w for w in words if w not in self.rows]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            own = slice(self.used, self.used + len(part))
            self.table[own, :-1], self.table[own, -1] = self.emissions(part)
            self.rows.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def shares(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Share of each label among the words of each text, then how familiar they are; None without words."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < 1_000_000:
                group.append(words_of(texts[at]))
                size += len(texts[at]) + 100
                at += 1
            self._known(set().union(*group))
            counts = np.array([len(g) for g in group])
            chains = -(-counts // CHAIN)
            total = int(chains.sum())
            if not total:
                yield from [None] * len(group)
                continue
            ids = np.full(total * CHAIN, -1, np.int64)
            first = np.concatenate(([0], np.cumsum(chains)[:-1]))
            for g, f in zip(group, first):
                ids[f * CHAIN : f * CHAIN + len(g)] = np.fromiter(map(self.rows.__getitem__, g), np.int64, len(g))
            ids = ids.reshape(total, CHAIN)
            sizes = (ids >= 0).sum(1)
            told = self.table[np.maximum(ids, 0)] * (ids >= 0)[:, :, None]
            emit = np.ascontiguousarray(told[:, :, :-1])
            emit[ids < 0] = 1
            marginals = forward_backward(emit, sizes, self.move.astype(np.float32), self.start.astype(np.float32))[0]
            marginals = np.concatenate((marginals.sum(1, dtype=np.float64), told[:, :, -1].sum(1, dtype=np.float64)[:, None]), axis=1)
            sums = np.zeros((len(group), len(self.labels) + 1))
            has = counts > 0
            sums[has] = np.add.reduceat(marginals, first[has], axis=0)
            for s, c in zip(sums, counts):
                yield s / c if c else None

    def word_labels(self, text: str) -> list[tuple[str, str]]:
        """Each word with its most likely label."""
        words = words_of(text)
        out = []
        for at in range(0, len(words), CHAIN):
            part = words[at : at + CHAIN]
            emit = self.emissions(part)[0][None]
            best = forward_backward(emit, np.array([len(part)]), self.move, self.start)[0][0].argmax(1)
            out += [(w, self.labels[b]) for w, b in zip(part, best)]
        return out


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.3, seed: int = 1) -> Model:
    """Fit by AdaGrad on code-switched chains made of labelled slices."""
    labels = sorted({label for label, _ in rows})
    size = len(labels)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((0, 0)), np.ones(0), np.zeros(BUCKETS, bool))
    rng = np.random.default_rng(seed)
    runs = []
    for label, text in sorted(rows):
        words, at = words_of(text), 0
        while at < len(words):
            step = int(rng.integers(6, 48))
            runs.append((labels.index(label), words[at : at + step]))
            at += step
    rng.shuffle(runs)
    stream = [(w, label) for label, run in runs for w in run]
    vocabulary = {w: i for i, w in enumerate(sorted({w for w, _ in stream}))}
    lists = [features(w) for w in vocabulary]
    if not stream:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((0, 0)), np.ones(0), np.zeros(BUCKETS, bool))
    counts = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, counts.sum())
    ids = np.array([vocabulary[w] for w, _ in stream])
    weights, moves, begins = fit(ids, np.array([y for _, y in stream]), flat, counts, size, epochs, rate, rng)
    return Model(labels, weights.astype(np.float32), np.exp(moves), np.exp(begins), usual_features(rows))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of lists that start at ``starts``, and where each list starts among them."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum())), first


def fit(stream: np.ndarray, labels: np.ndarray, flat: np.ndarray, counts: np.ndarray, size: int, epochs: int, rate: float, rng, most: int = 1 << 30):
    """Weights, moves and begins by AdaGrad over a stream of word numbers; word ``i`` has ``counts[i]`` features in ``flat``.

    A pass takes a step for about 128 chains, or ``most`` steps.
    """
    starts = np.cumsum(counts) - counts
    n = -(-len(stream) // CHAIN)
    ids, truth = np.zeros(n * CHAIN, np.int32), np.zeros(n * CHAIN, np.int32)
    ids[: len(stream)], truth[: len(stream)] = stream, labels
    ids, truth = ids.reshape(n, CHAIN), truth.reshape(n, CHAIN)
    sizes = np.full(n, CHAIN)
    sizes[-1] = len(stream) - (n - 1) * CHAIN
    weights, moves, begins = np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size)
    past = [np.full_like(x, 1e-6) for x in (weights, moves, begins)]
    eye = np.eye(size)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, min(most, n // 128))):
            own, inverse = np.unique(ids[part], return_inverse=True)
            at, first = ragged(starts[own], counts[own])
            met = flat[at]
            scores = np.add.reduceat(weights[met], first, axis=0)
            scores -= scores.max(1, keepdims=True)
            emit = np.exp(np.clip(scores, -30, 0))[inverse.reshape(ids[part].shape)]
            move, begin = np.exp(moves), np.exp(begins)
            marginals, ahead, back, _, live = forward_backward(emit, sizes[part], move, begin)
            gold = eye[truth[part]] * live[:, :, None]
            miss = (gold - marginals).reshape(-1, size)
            by_word = np.stack([np.bincount(inverse.ravel(), miss[:, k], len(own)) for k in range(size)], 1)
            spread = np.repeat(by_word, counts[own], axis=0)
            slope = np.stack([np.bincount(met, spread[:, k], BUCKETS) for k in range(size)], 1)
            pairs = ahead[:, :-1, :, None] * move * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
            pairs /= np.maximum(pairs.sum((2, 3), keepdims=True), 1e-30)
            both = live[:, 1:, None, None]
            seen = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            steps = (slope / len(part), ((seen - pairs) * both).sum((0, 1)) / len(part), (gold - marginals)[:, 0].sum(0) / len(part))
            for x, g, p in zip((weights, moves, begins), steps, past):
                p += g * g
                x += rate * g / np.sqrt(p)
    return weights, moves, begins


def shard_shapes(size: int) -> list[tuple[int, ...]]:
    """What a shard tells, with ``size`` labels: weights, how often each feature was met, moves, begins, the number
    of words; slices that hold a feature and slices in all, by half and label."""
    return [(BUCKETS, size), (BUCKETS,), (size, size), (size,), (1,), (2, size, BUCKETS), (2, size)]


def parts_of(line: np.ndarray, size: int) -> list[np.ndarray]:
    shapes = shard_shapes(size)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [x.reshape(s) for x, s in zip(np.split(line, ends), shapes)]


def shard_line(rows: Iterable[tuple[int, int, str]], size: int, name: int, rate: float = 0.3) -> np.ndarray | None:
    """All of ``shard_shapes`` in whole numbers, one behind the other, from ``(label, half, text)``; None without words.

    ``rows`` are read once: a text is held as the numbers of its words.
    """
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    texts, kept = [], []
    for label, half, text in rows:
        words = words_of(text)
        if words:
            texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            kept.append((label, half, -(-len(text) // SLICE)))
    if not texts:
        return None
    words, flats, counts = list(known), [], []
    for at in range(0, len(words), 20_000):
        own, sizes = features_of(words[at : at + 20_000])
        flats.append(own.astype(np.int32))
        counts.append(sizes)
    del known, words
    flat, counts = np.concatenate(flats), np.concatenate(counts)
    del flats
    starts = np.cumsum(counts) - counts
    holding, slices = np.zeros((2, size, BUCKETS), np.int32), np.zeros((2, size), np.int64)
    for own, (label, half, pieces) in zip(texts, kept):
        borders = [i * len(own) // pieces for i in range(pieces + 1)]
        for i, j in zip(borders, borders[1:]):
            if i < j:
                mark = np.zeros(BUCKETS, bool)
                # The first two features are the whole word and the bias.
                mark[flat[ragged(starts[own[i:j]] + 2, counts[own[i:j]] - 2)[0]]] = True
                holding[half, label] += mark
                slices[half, label] += 1
    stream = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    del texts
    labels = np.repeat(np.array([label for label, _, _ in kept], np.int32), sizes)
    rng = np.random.default_rng([1, name])
    # Runs of a text's words are dealt anew, so chains switch languages.
    cuts = np.cumsum(rng.integers(6, 48, len(stream) // 6 + 1))
    cuts = np.unique(np.concatenate(([0], cuts[cuts < len(stream)], np.cumsum(sizes)[:-1])))
    lengths, order = np.diff(np.append(cuts, len(stream))), rng.permutation(len(cuts))
    at = ragged(cuts[order], lengths[order])[0]
    batches = max(1, -(-len(stream) // CHAIN) // 128)
    epochs = max(1, min(EPOCHS, -(-STEPS // batches)))
    weights, moves, begins = fit(stream[at], labels[at], flat, counts, size, epochs, rate, rng, STEPS)
    times, met = np.bincount(stream, minlength=len(counts)), np.zeros(BUCKETS, np.int64)
    for i in range(0, len(counts), 20_000):
        own, n = counts[i : i + 20_000], times[i : i + 20_000]
        met += np.bincount(flat[starts[i] : starts[i] + own.sum()], np.repeat(n, own), BUCKETS).astype(np.int64)
    whole = [np.rint(x / GRAIN).astype(np.int64) for x in (weights, moves, begins)]
    n = len(stream)
    parts = [whole[0] * met[:, None], met, whole[1] * n, whole[2] * n, np.array([n]), holding, slices]
    return np.concatenate([p.ravel() for p in parts])


def sum_of_shards(batches: Iterable[pa.RecordBatch], number: dict[str, int]) -> np.ndarray | None:
    """The sum of all shards' lines, from rows in order of ``shard``; about ``READ_BYTES`` of texts are held at once."""

    def rows():
        for batch in by_bytes(batches, "text", READ_BYTES):
            yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "half", "text")))

    total = None
    for name, own in groupby(rows(), itemgetter(0)):
        line = shard_line(((number[label], half, text) for _, label, half, text in own), len(number), name)
        if line is not None:
            total = line if total is None else np.add(total, line, out=total)
    return total


def learnable_rows(docs: DataFrame, learnable) -> DataFrame:
    """``(label, half, text)`` and ``key`` of what may be learned from; either half holds about as many texts."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    half = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(2)).cast("int")
    return rows.select(F.col("lang").alias("label"), half.alias("half"), "text", text_key("text").alias("key"), "doc_id")


def learn(docs: DataFrame, learnable, shard: int = SHARD) -> tuple[Model, np.ndarray]:
    """The model of all ``learnable`` documents, and the usual features of one half of them (see ``learned_bound``).

    To the driver: the labels with their bytes, and one shard's sums.
    """
    rows = learnable_rows(docs, learnable)
    bytes_of = {r.label: r.n for r in rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    labels = sorted(bytes_of)
    size = len(labels)
    nothing = Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((0, 0)), np.ones(0), np.zeros(BUCKETS, bool)), np.zeros(BUCKETS, bool)
    if not labels:
        return nothing
    count = max(1, -(-sum(bytes_of.values()) // shard))
    number = {label: i for i, label in enumerate(labels)}
    form = "part int, sums binary"

    def told(lines, parts) -> pa.RecordBatch:
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array([x.tobytes() for x in lines], pa.binary())], ["part", "sums"])

    def run(batches):
        clear_worker()
        total = sum_of_shards(batches, number)
        if total is not None:
            yield told(np.array_split(total, GROUPS), range(GROUPS))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.Table.from_batches([told([total], table.column("part")[:1].to_pylist())])

    # Sums are as large as the model, so a few tasks a core add up what their shards tell.
    tasks = min(count, 3 * docs.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(count))).repartition(tasks, "shard")
    dealt = dealt.sortWithinPartitions("shard", "key", "label").select("shard", "label", "half", "text")
    sums = dealt.mapInArrow(run, form).groupBy("part").applyInArrow(add, form).collect()
    if not sums:
        return nothing
    line = np.concatenate([np.frombuffer(r.sums, np.int64) for r in sorted(sums, key=lambda r: r.part)])
    weights, met, moves, begins, n, holding, slices = parts_of(line, size)
    weights = weights * (GRAIN / np.maximum(met, 1))[:, None]
    moves, begins = moves * (GRAIN / n[0]), begins * (GRAIN / n[0])
    model = Model(labels, weights.astype(np.float32), np.exp(moves), np.exp(begins), usual_of(holding.sum(0), slices.sum(0)))
    return model, usual_of(holding[0], slices[0])


def usual_of(holding: np.ndarray, slices: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Features in at least this share of some label's slices (and in two), from counts by label."""
    return (holding >= np.maximum(2, share * slices)[:, None]).any(0)


def learned_bound(docs: DataFrame, learnable, usual: np.ndarray, slack: float = 0.6) -> float:
    """``familiar_bound`` over all ``learnable`` documents: ``usual`` of one half tells how familiar the other half's texts are.

    The median is one of ``BINS`` steps.  To the driver: a row a step.
    """

    def run(rows):
        known: dict[str, float] = {}
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            texts = [words for t in batch.column("text").to_pylist() if (words := words_of(t))]
            if len(known) > Model.limit:
                known.clear()
            new = list(set().union(*texts) - known.keys())
            for at in range(0, len(new), 20_000):
                flat, sizes = features_of(new[at : at + 20_000])
                starts, told = np.cumsum(sizes) - sizes, usual[flat].astype(np.float64)
                # The first two features are the whole word and the bias.
                told[starts] = told[starts + 1] = 0
                shares = np.add.reduceat(told, starts) / (sizes - 2)
                known.update(zip(new[at : at + 20_000], shares.tolist()))
            means = np.array([sum(map(known.__getitem__, words)) / len(words) for words in texts])
            steps, n = np.unique((means * BINS).astype(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(steps), pa.array(n.astype(np.int64))], ["step", "n"])

    other = learnable_rows(docs, learnable).where("half = 1").select("text")
    steps = other.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    steps = sorted((r.step, r.n) for r in steps)
    if not steps:
        return 0.0
    ends = np.cumsum([n for _, n in steps])
    middle = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
    return slack * float(np.mean([steps[i][0] for i in middle])) / BINS


def sample(docs: DataFrame, learnable, docs_per_label: int = 200, slice_chars: int = 2500) -> list[tuple[str, str]]:
    """The bounded training rows: ``docs_per_label`` distinct slices a label, by hash of the text."""
    size = F.length("text")
    at = (F.pmod(F.xxhash64("text"), F.greatest(size - slice_chars, F.lit(1))) + 1).cast("int")
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").alias("label"), F.substring("text", at, F.lit(slice_chars)).alias("part"), F.xxhash64("text", F.lit(11)).alias("h")
    )
    # Copies of a text are one slice, or a hot text would be all that is learned.
    first = W.partitionBy("label").orderBy("h")
    chosen = rows.select("label", "h").distinct().withColumn("n", F.row_number().over(first))
    chosen = F.broadcast(chosen.where(F.col("n") <= docs_per_label).drop("n"))  # docs_per_label rows a label
    kept = rows.join(chosen, ["label", "h"]).dropDuplicates(["label", "h"])
    return sorted((r.label, r.part) for r in kept.select("label", "part").collect())


def usual_features(rows: list[tuple[str, str]], share: float = 0.1) -> np.ndarray:
    """Features in at least this share of some label's slices (and in two): junk among them adds none."""
    usual = np.zeros(BUCKETS, bool)
    for label in {label for label, _ in rows}:
        counts, slices = np.zeros(BUCKETS, np.int64), 0
        for own, text in rows:
            if own == label and (words := set(words_of(text))):
                counts[np.unique([f for w in words for f in features(w)[2:]])] += 1
                slices += 1
        usual |= counts >= max(2, share * slices)
    return usual


def familiar_bound(rows: list[tuple[str, str]], slack: float = 0.6) -> float:
    """Texts less ``familiar`` than this are of no learned language.

    One half of the sample tells how familiar the other half's texts are.  Their median times
    ``slack`` is the bound, which follows the sample's size, does not depend on the number of
    labels and is not moved by some junk in the sample.  Without two texts of words nothing is below it.
    """
    ranked = sorted(rows, key=lambda r: zlib.crc32(r[1].encode()))
    usual = usual_features(ranked[::2])
    texts = [words for _, text in ranked[1::2] if (words := words_of(text))]
    shares = [np.mean([usual[features(w)[2:]].mean() for w in words]) for words in texts]
    return float(np.median(shares)) * slack if shares else 0.0


def predict(docs: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """``key`` columns, ``lang_pred``, ``score`` and ``familiar`` of whole texts.

    The new columns replace key columns of the same names.  ``familiar`` is the mean share of
    a word's affixes and n-grams that are usual in some learned language: it tells text of
    none of them, whatever their number (null without words).
    """
    types = dict(docs.dtypes)
    key = [k for k in key if k not in ("lang_pred", "score", "familiar")]

    def run(rows):
        for batch in by_bytes(rows, "_text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            names, scores, known = [], [], []
            for share in model.shares(texts) if model.labels else [None] * len(texts):
                best = 0 if share is None else int(share[:-1].argmax())
                names.append(UNKNOWN if share is None else model.labels[best])
                scores.append(0.0 if share is None else min(1.0, float(share[best])))
                known.append(None if share is None else float(share[-1]))
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
            yield pa.record_batch([*(batch.column(i) for i in range(len(key))), *new], [*key, "lang_pred", "score", "familiar"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", lang_pred string, score double, familiar double"
    texts = docs.select(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(key)), F.col("text").alias("_text"))
    return texts.mapInArrow(run, schema)
