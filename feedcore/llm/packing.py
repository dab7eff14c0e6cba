"""Packing by minimum bin slack.

Token lists are cut into full windows and a remainder, which stays whole.  Remainders are chosen by
their lengths alone: the histogram of lengths has fewer entries than the window,
however large the corpus, so one bounded table describes all windows.  For each
window a bitset holds the fills that the remaining lengths can reach; the fill
closest to the capacity is traced back to counts of lengths, and the pattern is
repeated as long as the counts allow.  Pieces then take the places of their length
in the order of a salted rank, so copies of one text never meet in one task.

Where most remainders are over half a window, no choice of them fills it; ``cut_every``
then cuts one document in so many into powers of two, which close the gaps.

Nulls: a null text counts as empty (one token, the end).  A null ``doc_id`` is kept
as it is.  Repeated rows are documents of their own.  Only ``doc_id`` and ``text`` are read, whatever else a
table holds.  A long text is many windows; its ids are in memory once.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedcore.llm.common import as_bytes, batch_of, in_worker, stage

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_hash long"
_PIECES = pa.schema([(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens text_hash".split()])
#: A word of ASCII or Latin-1 small letters with a comma or full stop behind it.
_ENDED = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+[,.]")


class WordIds(dict):
    """Token ids (packed, little-endian) of byte words, made in batches by ``tokenizers``.

    Only ASCII white space separates the words.  The tokenizer drops it and never
    joins over it, so words can be encoded apart: thousands of new ones are one text,
    between separators of one known id.  Words not met since the last turn of the
    generations are forgotten, so memory is bounded and frequent words stay.
    """

    #: Words of a generation; there are two.
    limit = 800_000
    joined = 4096

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        mark = self.ids(["\0", "a \0 a"])
        #: The id between words, or None if a separator isn't one id of its own.
        self.mark = mark[0][0] if len(mark[0]) == 1 and mark[1][1:-1].tolist() == mark[0].tolist() else None
        #: Whether A-Z and a-z are one to the tokenizer.
        self.lower = len({i.tobytes() for i in self.ids(["The AbC xyZ", "the abc xyz", "THE ABC XYZ"])}) == 1

        probes = ["abc", "é", "zzq", "naïveté", "d", "s", "don"]
        whole = self.ids([w + c for w in probes for c in ",."])
        parts = [np.concatenate(self.ids([w, c])) for w in probes for c in ",."]
        self.ends = all(np.array_equal(a, b) for a, b in zip(whole, parts))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        # A comma or full stop behind a letter is a token of its own, so the word before it may be known.
        ended = {w for w in words if self.ends and _ENDED.fullmatch(w) and w not in self.old}
        if ended:
            parts = {w[:-1] for w in ended} | {w[-1:] for w in ended}
            self.learn(parts - self.keys() | words - ended)
            self.update((w, self[w[:-1]] + self[w[-1:]]) for w in ended)
            return
        known = words & self.old.keys()
        self.update((w, self.old[w]) for w in known)
        new = list(words - known)
        if self.mark is None:
            self.update(zip(new, (i.tobytes() for i in self.ids([w.decode() for w in new]))))
            return
        alone = [w for w in new if b"\0" in w]
        self.update(zip(alone, (i.tobytes() for i in self.ids([w.decode() for w in alone]))))
        new = [w for w in new if b"\0" not in w] if alone else new
        parts = [new[i : i + self.joined] for i in range(0, len(new), self.joined)]
        for part, found in zip(parts, self.ids([b" \0 ".join(part).decode() for part in parts])):
            marks = np.flatnonzero(found == self.mark)
            data, starts = found.tobytes(), (4 * np.concatenate(([0], marks + 1))).tolist()
            ends = (4 * np.append(marks, len(found))).tolist()
            self.update((w, data[i:j]) for w, i, j in zip(part, starts, ends, strict=True))

    def words(self, text: bytes) -> list[bytes]:
        # A letter and a combining mark (U+0300 to U+036F) may compose in one case alone.
        if self.lower and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return text.split()

    def encode(self, texts: list[bytes], end: int) -> Iterator[bytes]:
        """Packed ids of each text, with the end token."""
        tail, at = array("I", [end]).tobytes(), 0
        while at < len(texts):
            words, found, size = [], [], 0
            while at < len(texts) and size < 4_000_000:
                words.append(self.words(texts[at]))
                found.append(list(map(self.get, words[-1])))
                size += len(texts[at])
                at += 1
            open_ = [i for i, f in enumerate(found) if None in f]
            lost = {i: [w for w, v in zip(words[i], found[i]) if v is None] for i in open_}
            if lost:
                if len(self) > self.limit:
                    self.old = dict(self)
                    self.clear()
                self.learn(set().union(*lost.values()))
            for i, own in enumerate(found):
                if i in lost:
                    late = iter(lost[i])
                    own = [self[next(late)] if v is None else v for v in own]
                yield b"".join(own) + tail


def word_ids(path: str) -> WordIds:
    """The word ids of this process; a later task of the same worker finds the words of earlier ones."""
    return in_worker(("words", path), lambda: WordIds(path))


def cuts(n: int, window: int, small: bool) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full windows, then the rest, whole or in powers of two."""
    rest = n % window
    parts = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1] if small else [rest] * (rest > 0)
    return [window] * (n // window) + parts


def token_pieces(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, cut_every: int | None = None) -> DataFrame:
    """Pieces of all documents: a narrow row each; the ids stay in the task.

    A driver of real training files calls :func:`sequences` for the ids themselves.
    """

    def run(rows):
        ids = word_ids(tokenizer)
        for batch in rows:
            out: list[list[int]] = [[] for _ in _PIECES]
            keys, hashes = (batch.column(name).to_pylist() for name in ("doc_id", "_hash"))
            for key, hashed, data in zip(keys, hashes, ids.encode(as_bytes(batch, "text"), end)):
                n, start, view = len(data) // 4, 0, memoryview(data)
                chosen = cut_every is not None and zlib.crc32(str(key).encode()) % cut_every == 0
                for length in cuts(n, window, chosen):
                    row = (key, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), n, hashed)
                    for column, value in zip(out, row):
                        column.append(value)
                    start += length
            yield batch_of(_PIECES, *out)

    return hashed_texts(docs).mapInArrow(run, PIECES)


def hashed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _hash``: the hash tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))


def fill(counts: dict[int, int], lengths: list[int], first: int, capacity: int) -> dict[int, int]:
    """The multiset that holds ``first`` and fills the capacity closest, as ``{length: count}``.

    ``reach`` has bit ``t`` set if lengths taken so far can sum to ``t``.  A count is
    split into powers of two, one shift each.  The steps are kept for the way back.
    """
    room = capacity - first
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room or reach >> room & 1:
            continue
        left = min(counts[length] - (length == first), room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, part = left - take, part * 2
            if reach >> room & 1:
                break
    goal = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            used[length] = used.get(length, 0) + take
            goal -= length * take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: ``(length, from_rank, to_rank, per_sequence, first_sequence, first_offset)``.

    A pattern is repeated until one of its lengths runs short, which then has at most
    half its count left: there are at most ``window * (1 + log2(pieces))`` patterns.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    given = dict.fromkeys(counts, 0)
    order = sorted(counts, reverse=True)
    places, sequence = [], 0
    while order:
        used = fill(counts, order, order[0], window)
        times = min(counts[n] // c for n, c in used.items())
        offset = 0
        for n, c in sorted(used.items(), reverse=True):
            places.append((n, given[n], given[n] + times * c, c, sequence, offset))
            offset += n * c
            given[n] += times * c
            counts[n] -= times * c
        sequence += times
        order = [n for n in order if counts[n]]
    return places


def place(pieces: DataFrame, window: int = WINDOW, rows_per_salt: int = 1000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces.

    Broadcast: the places, bounded as in :func:`plan`.  The rank of a piece among
    those of its length is a window over (length, salt) plus the sum of the salts
    before; there are at most 4096 salts, so that sum has at most 4096 rows a length.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    salts = max(1, min(4096, -(-total // rows_per_salt)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1)
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = ranked.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    places = spark.createDataFrame(
        plan(histogram, window), "_length long, _lo long, _hi long, _per long, _first long, _offset long"
    )
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(places), inside).select(
        *pieces.columns,
        (F.col("_first") + F.floor(at / F.col("_per"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_per") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, cut_every: int | None = None) -> DataFrame:
    """Pack all documents: one row a piece."""
    return place(stage(token_pieces(docs, tokenizer, end, window, cut_every), "pieces"), window)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end: int, pad: int = 0, window: int = WINDOW) -> DataFrame:
    """The sequences themselves: ``(sequence_id, input_ids, doc_starts)``, padded unless at a power of two.

    Pieces meet their text again by ``doc_id`` and the text's hash; rows that repeat both
    are one text here, since each has pieces of its own.  A sequence is one group of at
    most ``window`` ids.
    """
    wanted = packed.select(F.col("doc_id").alias("_doc"), "text_hash", "start", "length", "sequence_id", "offset")
    texts = hashed_texts(docs).dropDuplicates(["doc_id", "_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("text_hash"))
    joined = texts.join(wanted, same)

    def cut(rows):
        ids = word_ids(tokenizer)
        names = ["start", "length", "sequence_id", "offset"]
        for batch in rows:
            where = [batch.column(n).to_pylist() for n in names]
            texts = as_bytes(batch, "text")
            out = [
                np.frombuffer(data, "<u4")[s : s + n].astype(np.int64).tolist()
                for data, s, n in zip(ids.encode(texts, end), *where[:2])
            ]
            yield pa.record_batch([pa.array(where[2]), pa.array(where[3]), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    parts = joined.mapInArrow(cut, "sequence_id long, offset long, ids array<long>")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    size = F.size(ids)
    power = F.bit_count(size.cast("long")) == 1
    missing = F.when(power, 0).otherwise(window - size)
    return whole.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), missing.cast("int"))).alias("input_ids"),
        F.col("p.offset").alias("doc_starts"),
    )


