"""Byte-level BPE with a segment tree.

The leaves of the tree are the byte positions of a piece; a leaf holds the rank of
the pair that starts there, the root the smallest (rank, position): the leftmost
best merge.  A merge writes the new token, unlinks its right half and updates three
leaves (the pair before, at and after it), each on a path of logarithmic length.
Short pieces are merged side by side, one tree per row of an array; long ones one
by one.  Tokens of chunks are remembered per worker, in bounded memory.

Nulls: a null text counts as empty and has no tokens.  Repeated rows are rows of
their own.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedcore.llm.common import batch_of

# The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int64(1) << 62


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """The rank of joining two tokens, as sorted arrays and as a dict."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[token[:cut]], ranks[token[cut:]]): rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.array(list(pairs.values()), np.int64)[order]

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where it is no token (or ``right`` is missing, -1)."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.values[at], NONE)


def merge_side_by_side(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Packed ids of pieces of like length: row ``i`` of the tree array belongs to piece ``i``."""
    n, width = len(pieces), 1 << (max(map(len, pieces)) - 1).bit_length()
    raw = np.zeros((n, width + 2), np.uint8)
    for i, piece in enumerate(pieces):
        raw[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    # One more column: where links off the end point to.
    token = np.where(np.arange(width + 2) < sizes[:, None], merges.single[raw], -1)
    after = np.tile(np.arange(1, width + 3), (n, 1))
    after[:, -2:] = width + 1
    before = np.tile(np.arange(-1, width + 1), (n, 1))
    before[:, 0] = width + 1
    bits = width.bit_length()
    tree = np.full((n, 2 * width), NONE, np.int64)
    start = merges.look(token[:, :width], token[:, 1 : width + 1])
    tree[:, width:] = np.where((start < NONE) & (token[:, :width] >= 0), start << bits | np.arange(width), NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.arange(n)
    while True:
        rows = rows[tree[rows, 1] < NONE]
        if not len(rows):
            break
        best = tree[rows, 1]
        at = best & (1 << bits) - 1
        token[rows, at] = best >> bits
        gone = after[rows, at]
        right = after[rows, gone]
        token[rows, gone] = -1
        after[rows, at] = right
        before[rows, right] = at
        before[rows, -1] = width + 1
        left = before[rows, at]
        for spot, value in (
            (gone, np.full(len(rows), NONE)),
            (at, merges.look(token[rows, at], token[rows, right])),
            (left, np.where(left <= width, merges.look(token[rows, np.minimum(left, width)], token[rows, at]), NONE)),
        ):
            real = spot < width
            own, node = rows[real], spot[real] + width
            tree[own, node] = np.where(value[real] < NONE, value[real] << bits | spot[real], NONE)
            while len(node) and width > 1:
                node = node >> 1
                tree[own, node] = np.minimum(tree[own, 2 * node], tree[own, 2 * node + 1])
                if node[0] == 1:
                    break
    kept = token[:, :width] >= 0
    flat = token[:, :width][kept].astype("<u4")
    return [p.tobytes() for p in np.split(flat, np.cumsum(kept.sum(1))[:-1])]


def merge_alone(piece: bytes, merges: Merges) -> bytes:
    """The same with one tree, for long pieces."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    bits, none = width.bit_length(), int(NONE)
    token = [int(merges.single[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    look = merges.pairs.get
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = look((token[i], token[i + 1]))
        if rank is not None:
            tree[width + i] = rank << bits | i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(spot: int, other: int) -> None:
        rank = look((token[spot], token[other])) if spot >= 0 and other < n else None
        node = spot + width
        tree[node] = none if rank is None else rank << bits | spot
        while node > 1:
            node >>= 1
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best

    while tree[1] < none:
        at = tree[1] & (1 << bits) - 1
        token[at] = tree[1] >> bits
        gone = after[at]
        right = after[gone]
        after[at] = right
        token[gone] = -1
        if right < n:
            before[right] = at
        update(gone, n)
        update(at, right)
        if before[at] >= 0:
            update(before[at], at)
    return array("I", [t for t in token if t >= 0]).tobytes()


class Encoder:
    """Texts to packed ids.  ``chunks`` remembers white-space separated chunks."""

    limit = 900_000
    #: Pieces up to this length are merged side by side.
    side_by_side = 64

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.merges = Merges(ranks_of(path))
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        # A chunk is what the pattern can't match across: a word with one space before it, or white space.
        self.split = re.compile(f"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+").findall
        self.chunks: dict[str, bytes] = {}
        self.by_id = [b""] * (max(self.merges.ranks.values()) + 1)
        for token, rank in self.merges.ranks.items():
            self.by_id[rank] = token

    def learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        cut = {c: [p.encode() for p in self.pieces.findall(c)] for c in chunks}
        ids, ranks, classes = {}, self.merges.ranks, {}
        for piece in set().union(*cut.values()):
            if piece in ranks:
                ids[piece] = array("I", [ranks[piece]]).tobytes()
            elif len(piece) > self.side_by_side:
                ids[piece] = merge_alone(piece, self.merges)
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for same in classes.values():
            for at in range(0, len(same), 20_000):
                part = same[at : at + 20_000]
                ids.update(zip(part, merge_side_by_side(part, self.merges)))
        self.chunks.update((c, b"".join([ids[p] for p in own])) for c, own in cut.items())

    def encode(self, text: str) -> bytes:
        chunks = self.split(text)
        found = list(map(self.chunks.get, chunks))
        if None in found:
            self.learn({c for c, v in zip(chunks, found) if v is None})
            found = [self.chunks[c] if v is None else v for c, v in zip(chunks, found)]
        return b"".join(found)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As :meth:`encode`, but new chunks of many texts are merged together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            cut, found, size = [], [], 0
            while at < len(texts) and size < 4_000_000:
                cut.append(self.split(texts[at]))
                found.append(list(map(self.chunks.get, cut[-1])))
                size += len(texts[at])
                at += 1
            lost = {i: [c for c, v in zip(cut[i], f) if v is None] for i, f in enumerate(found) if None in f}
            if lost:
                self.learn(set().union(*lost.values()))
            for i, own in enumerate(found):
                if i in lost:
                    late = iter(lost[i])
                    own = [self.chunks[next(late)] if v is None else v for v in own]
                out.append(b"".join(own))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, memoryview(packed).cast("I")))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of whole texts."""

    def run(rows):
        encoder = Encoder(path, pattern)
        for batch in rows:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = [np.frombuffer(p, "<u4").astype(np.int64) for p in encoder.encode_all(texts)]
            yield pa.record_batch([batch.column(key), pa.array(ids, pa.list_(pa.int64()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<bigint>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, data)``: the bytes that ids stand for."""

    def run(rows):
        encoder = Encoder(path, pattern)
        for batch in rows:
            data = [encoder.decode(array("I", ids or []).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array(data, pa.binary())], [key, "data"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {dict(encoded.dtypes)[key]}, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one task, so that ids of whole texts are not moved."""

    def run(rows):
        encoder = Encoder(path, pattern)
        for batch in rows:
            packed = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield batch_of(
                _DIGESTS,
                batch.column("doc_id"),
                [len(p) // 4 for p in packed],
                [hashlib.sha256(p).hexdigest() for p in packed],
                [hashlib.sha256(encoder.decode(p)).hexdigest() for p in packed],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
