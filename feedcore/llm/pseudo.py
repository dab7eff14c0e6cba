"""Masked pseudo-likelihood with a bidirectional window network in numpy.

A token is predicted from the ``REACH`` tokens on either side of it: each place has
its own embeddings, their sum goes through tanh, and the output is factored into a
class and a member of the class.  A document's score is the sum of the log
probabilities of its tokens, each masked in its turn.

Words are lower-cased and told apart by 64-bit hashes.  A grouped count over all
documents gives every word its number of occurrences, so the vocabulary grows with the
corpus.  The ``FREQUENT`` most frequent words are tokens of their own.  The others,
sorted by frequency, are cut into shared tokens of equal weight; inside one, a word's
probability is its part of the token's occurrences, so every word has its own.  Words
seen twice or more go to the tasks (12 bytes a word and 2 for its token); any other
word counts as seen once.

The network starts as the word counts alone.  Texts, in pieces of ``PIECE`` tokens, are
dealt by hash of id and text to shards of about ``shard`` tokens; each shard trains a copy
of the network on its pieces in order of their keys, and the weights are averaged by tokens
seen, round by round.  Sums are kept in whole numbers, so neither the network nor a score
depends on how rows lie in partitions.  All documents are learned from (or one in
``train_every``, by hash of the text).

Nulls: a null text counts as empty: no tokens, score 0, null mean.  Repeated rows are
counted and scored as rows of their own; a row that repeats id and text is learned from
once.  Long texts are read whole.  Only ``doc_id`` and ``text`` are read, so other columns
cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import as_bytes, by_bytes, stage, text_key, word_hashes

FREQUENT = 768
VOCABULARY = 1024
CLASS = 32
REACH = 2
WIDTH = 16
BATCH_BYTES = 4 << 20
HELD_WORDS = 1 << 20
ONCE = 256
ROWS = 256
#: From so few on, columns are compared one by one.
COLUMNS = 8
#: Tokens scored at once: what is worked on stays in a core's cache.
SCORED = 8192
PIECE = 1 << 16
SHARD = 1 << 20
#: Weights are added up as whole multiples of this.
GRAIN = 2.0**-20
#: A round's sums are merged in so many groups.
SLICES = 32


class Vocabulary:
    """Words seen twice or more (sorted hashes) with token and count; ``once[i]`` others, with last byte ``i``, were seen."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, once: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, counts = words[order], counts[order].astype(np.int64)
        self.logs = np.log(counts).astype(np.float32)
        rank = np.lexsort((self.words, -counts))
        token = np.empty(len(counts), np.int64)
        token[rank[:FREQUENT]] = np.arange(min(FREQUENT, len(rank)))
        rest = rank[FREQUENT:]
        # A word's place is the middle of its stretch of occurrences.
        ends = np.cumsum(counts[rest])
        total, shared = int(once.sum() + counts[rest].sum()), VOCABULARY - FREQUENT
        token[rest] = FREQUENT + ((ends - counts[rest] / 2) / max(total, 1) * shared).astype(np.int64)
        first = min(FREQUENT + (total - int(once.sum())) * shared // max(total, 1), VOCABULARY - 1)
        seldom = first + np.arange(len(once)) * (VOCABULARY - first) // len(once)
        # Neighbours in frequency are spread over the classes.
        spread = (np.arange(VOCABULARY) % CLASS) * (VOCABULARY // CLASS) + np.arange(VOCABULARY) // CLASS
        weights = np.bincount(token, counts, VOCABULARY)
        np.add.at(weights, seldom, once)
        self.total = int(counts.sum() + once.sum())
        self.weights = np.empty(VOCABULARY, np.float32)
        self.weights[spread] = np.log(np.maximum(weights, 1))
        self.tokens, self.seldom = spread[token].astype(np.int16), spread[seldom]

    def parts(self) -> dict[str, np.ndarray]:
        return dict(vars(self))

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> Vocabulary:
        """Plain arrays are broadcast, as a class of this package could not be found by name everywhere."""
        own = cls.__new__(cls)
        vars(own).update(parts)
        return own

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token of each word, and the log of the word's part of it."""
        token, part = self.seldom[(words & np.uint64(ONCE - 1)).astype(np.int64)], np.zeros(len(words), np.float32)
        if len(self.words):
            # In order, words are found several times faster than at random.
            order, at = np.argsort(words), np.empty(len(words), np.int64)
            at[order] = np.minimum(np.searchsorted(self.words, words[order]), len(self.words) - 1)
            own = self.words[at] == words
            token = np.where(own, self.tokens[at], token)
            part = np.where(own, self.logs[at], part)
        return token, part - self.weights[token]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences of every word, by hash."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def batch_of_counts(words, counts):
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    def count(rows):
        held, size = [], 0
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            words = word_hashes(as_bytes(batch, "text"), lower=True)[0]
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [told(held)]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield batch_of_counts(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of_counts(*told(held))

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Tokens and counts of all words, from all documents."""
    counts = stage(word_counts(docs), "words")
    once = np.zeros(ONCE, np.int64)
    for row in counts.where("n = 1").groupBy(F.pmod("word", F.lit(ONCE)).alias("at")).count().collect():
        once[row["at"]] = row["count"]
    often = counts.where("n > 1").toArrow()
    words, n = (often.column(c).to_numpy() for c in ("word", "n"))
    return Vocabulary(words.view(np.uint64), n, once)


def product(left: np.ndarray, right: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``left @ right``, few rows at a time: larger products start threads beyond a task's core."""
    out = np.empty((len(left), right.shape[1]), np.float32) if out is None else out
    for at in range(0, len(left), ROWS):
        np.matmul(left[at : at + ROWS], right, out=out[at : at + ROWS])
    return out


class Network:
    """``inside[place, token]`` embeddings; ``upper`` scores classes, ``lower[class]`` their members."""

    def __init__(self, parts: list[np.ndarray] | None = None) -> None:
        if parts is None:
            rng = np.random.default_rng(5)
            parts = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in self.shapes()]
            parts[1][-1] = parts[2][:, -1] = 0
        self.inside, self.upper, self.lower = parts
        self.squares = [np.full(p.shape, 1e-8, np.float32) for p in parts]

    @staticmethod
    def shapes() -> tuple[tuple[int, ...], ...]:
        return (2 * REACH, VOCABULARY + 1, WIDTH), (WIDTH + 1, CLASS), (CLASS, WIDTH + 1, VOCABULARY // CLASS)

    @classmethod
    def of_counts(cls, known: Vocabulary) -> Network:
        """A network that gives every token its part of the counts, whatever lies around."""
        own = cls()
        weights = known.weights.reshape(CLASS, -1)
        own.upper[:] = own.lower[:] = 0
        own.lower[:, -1] = weights
        own.upper[-1] = np.log(np.exp(weights.astype(np.float64)).sum(1))
        own.upper[-1] -= own.upper[-1].max()
        return own

    @classmethod
    def of_line(cls, line: np.ndarray) -> Network:
        """From all weights, one behind the other."""
        sizes = np.cumsum([int(np.prod(s)) for s in cls.shapes()])[:-1]
        return cls([p.reshape(s).copy() for p, s in zip(np.split(line, sizes), cls.shapes())])

    def line(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def parts(self) -> list[np.ndarray]:
        return [self.inside, self.upper, self.lower]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.inside[0].take(around[0], axis=0)
        for place in range(1, 2 * REACH):
            total += self.inside[place].take(around[place], axis=0)
        out = np.ones((len(total), WIDTH + 1), np.float32)
        out[:, :WIDTH] = np.tanh(total, out=total)
        return out

    @staticmethod
    def lowered(scores: np.ndarray) -> np.ndarray:
        """Scores less the largest of each row; halves are compared, as rows are short, and then columns."""
        most, width = scores, scores.shape[1]
        while width > COLUMNS:
            width //= 2
            most = np.maximum(most[:, :width], most[:, width : 2 * width])
        largest = np.maximum(most[:, 0], most[:, 1])
        for column in range(2, width):
            np.maximum(largest, most[:, column], out=largest)
        scores -= largest[:, None]
        return scores

    @classmethod
    def log_softmax_of(cls, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The log softmax of each row at one place of it."""
        scores = cls.lowered(scores)
        own = scores[np.arange(len(scores)), places]
        return own - np.log(np.exp(scores, out=scores).sum(1))

    @classmethod
    def softmax(cls, scores: np.ndarray) -> np.ndarray:
        scores = cls.lowered(scores)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of every token given both sides; ``around[place]`` are the tokens there."""
        hidden = self.hidden(around)
        group, member = np.divmod(token, VOCABULARY // CLASS)
        out = self.log_softmax_of(product(hidden, self.upper), group)
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(CLASS + 1)).tolist()
        hidden, inner = hidden.take(order, axis=0), np.empty((len(token), VOCABULARY // CLASS), np.float32)
        for c, (i, j) in enumerate(zip(ends, ends[1:])):
            product(hidden[i:j], self.lower[c], inner[i:j])
        out[order] += self.log_softmax_of(inner, member[order])
        return out

    def learn(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step down the gradient of the log loss, each weight by its own past slopes."""
        n = len(token)
        order = np.argsort(token.astype(np.int16), kind="stable")
        around, token = around.take(order, axis=1), token[order]
        hidden = self.hidden(around)
        group, member = np.divmod(token, VOCABULARY // CLASS)
        miss = self.softmax(product(hidden, self.upper))
        miss[np.arange(n), group] -= 1
        back = product(miss, self.upper.T)
        upper = sum(hidden[at : at + ROWS].T @ miss[at : at + ROWS] for at in range(0, n, ROWS))
        ends = np.searchsorted(group, np.arange(CLASS + 1)).tolist()
        filled = [(c, i, j) for c, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
        off = np.empty((n, VOCABULARY // CLASS), np.float32)
        for c, i, j in filled:
            product(hidden[i:j], self.lower[c], off[i:j])
        off = self.softmax(off)
        off[np.arange(n), member] -= 1
        lower, below = np.zeros_like(self.lower), np.empty_like(hidden)
        for c, i, j in filled:
            product(off[i:j], self.lower[c].T, below[i:j])
            np.matmul(hidden[i:j].T, off[i:j], out=lower[c])
        slope = (back + below)[:, :WIDTH] * (1 - hidden[:, :WIDTH] ** 2)
        for weights, squares, down in zip((self.upper, self.lower), self.squares[1:], (upper, lower)):
            squares += down * down
            weights -= rate * down / np.sqrt(squares)
        for inside, squares, tokens in zip(self.inside, self.squares[0], around):
            order = np.argsort(tokens.astype(np.int16), kind="stable")
            own = tokens[order]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            down, own = np.add.reduceat(slope.take(order, axis=0), starts), own[starts]
            past = squares[own] + down * down
            squares[own] = past
            inside[own] -= rate * down / np.sqrt(past)


def lined(texts: list[bytes], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in a line, their places there, logs of the words' parts of them, and texts' sizes."""
    words, sizes = word_hashes(texts, lower=True)
    tokens, parts = known.look(words)
    # Texts are set apart by places beyond the vocabulary.
    at = np.arange(len(tokens)) + REACH * (np.repeat(np.arange(len(texts)), sizes) + 1)
    line = np.full(len(tokens) + REACH * (len(texts) + 1), VOCABULARY, np.int64)
    line[at] = tokens
    return line, at, parts, sizes


def neighbours(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line[at + d] for d in range(-REACH, REACH + 1) if d])


def windows(texts: list[bytes], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens around, tokens, logs of the words' parts of them, and the number of tokens of each text."""
    line, at, parts, sizes = lined(texts, known)
    return neighbours(line, at), line[at], parts, sizes


def shards(docs: DataFrame, known: Vocabulary, shard: int = SHARD) -> DataFrame:
    """Staged ``(shard, lines, sizes)``: pieces of texts, each with ``REACH`` places more on either side."""
    count = max(1, -(-known.total // shard))
    given = docs.sparkSession.sparkContext.broadcast(known.parts())
    names = ["doc_id", "key", "piece", "line"]

    def cut(rows):
        tokens, met = Vocabulary.of(given.value), set()
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            line, _, _, sizes = lined(as_bytes(batch, "text"), tokens)
            line = line.astype(np.int16)
            ends = np.cumsum(sizes + REACH)
            out = {n: [] for n in names}
            for doc, key, size, end in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), sizes.tolist(), ends.tolist()):
                # Rows that repeat are told apart from others here as far as they lie together, and for good in their shard.
                if not size or (doc, key) in met:
                    continue
                if len(met) == HELD_WORDS:
                    met.clear()
                met.add((doc, key))
                for piece, start in enumerate(range(end - size, end, PIECE)):
                    stop = min(start + PIECE, end)
                    for n, v in zip(names, (doc, key, piece, line[start - REACH : stop + REACH].tobytes())):
                        out[n].append(v)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    def gather(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(n).to_pylist() for n in names))
        distinct = {(doc is None, doc or 0, key, piece): line for doc, key, piece, line in rows}
        lines = [distinct[name] for name in sorted(distinct)]
        sizes = np.array([len(x) // 2 for x in lines], np.int64)
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int64()), "lines": pa.array([b"".join(lines)], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("key"))
    pieces = keyed.mapInArrow(cut, "doc_id long, key binary, piece long, line binary")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(count)))
    # As many files as shards, so that a round has work for all cores.
    dealt = dealt.repartition(min(count, 4096), "shard")
    return stage(dealt.groupBy("shard").applyInArrow(gather, "shard long, lines binary, sizes binary"), "shards")


def train(docs: DataFrame, known: Vocabulary, rounds: int = 2, train_every: int = 1, rate: float = 0.1, step: int = 2048, shard: int = SHARD) -> Network:
    """Average of networks trained shard by shard."""
    spark = docs.sparkSession
    network = Network.of_counts(known)
    mine = docs.select("doc_id", "text")
    if train_every > 1:
        mine = mine.where(F.pmod(F.xxhash64("text"), F.lit(train_every)) == 0)
    dealt = shards(mine, known, shard)
    form = "slice int, weights binary, seen long"

    def told(sums: np.ndarray, seen: int, slices=range(SLICES)) -> dict[str, pa.Array]:
        return {"slice": pa.array(slices, pa.int32()), "weights": pa.array([x.tobytes() for x in sums], pa.binary()), "seen": pa.array([seen] * len(slices), pa.int64())}

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("weights").to_pylist())
        return pa.table(told([total], sum(table.column("seen").to_pylist()), table.column("slice")[:1].to_pylist()))

    for turn in range(rounds):
        given = spark.sparkContext.broadcast(network.line())

        def run(rows, given=given, turn=turn):
            sums, seen = 0, 0
            for batch in rows:
                for name, lines, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "lines", "sizes"))):
                    # Narrow numbers stay in a core's cache, where a step's places lie at random.
                    line, sizes = np.frombuffer(lines, np.int16), np.frombuffer(sizes, np.int64)
                    inner = np.ones(len(line), bool)
                    for d in range(REACH):
                        inner[np.cumsum(sizes) - 1 - d] = inner[np.cumsum(sizes) - sizes + d] = False
                    at = np.random.default_rng([turn, name]).permutation(np.flatnonzero(inner))
                    own = Network.of_line(given.value)
                    for i in range(0, len(at), step):
                        own.learn(neighbours(line, at[i : i + step]), line[at[i : i + step]].astype(np.int64), rate)
                    sums, seen = sums + np.rint(own.line() / GRAIN).astype(np.int64) * len(at), seen + len(at)
            if seen:
                yield pa.record_batch(told(np.array_split(sums, SLICES), seen))

        rows = dealt.mapInArrow(run, form).groupBy("slice").applyInArrow(add, form).collect()
        if rows:
            means = [np.frombuffer(r.weights, np.int64) * (GRAIN / r.seen) for r in sorted(rows, key=lambda r: r["slice"])]
            network = Network.of_line(np.concatenate(means).astype(np.float32))
    return network


def score(docs: DataFrame, known: Vocabulary, network: Network) -> DataFrame:
    """``(doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability)`` of whole texts."""
    given = docs.sparkSession.sparkContext.broadcast((network.parts(), known.parts()))
    form = "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double"

    def run(rows):
        parts, tokens = given.value[0], Vocabulary.of(given.value[1])
        own = Network(parts)
        for batch in by_bytes(rows, "text", BATCH_BYTES):
            around, token, own_part, sizes = windows(as_bytes(batch, "text"), tokens)
            told = np.empty(len(token))
            for at in range(0, len(token), SCORED):
                told[at : at + SCORED] = own.log_probabilities(around[:, at : at + SCORED], token[at : at + SCORED])
            sums = np.concatenate(([0.0], np.cumsum(told + own_part)))
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            means = [float(t / n) if n else None for t, n in zip(total, sizes)]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(total), pa.array(means, pa.float64())],
                ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, form)
