"""Fill-in-the-middle: cut texts at borders of units and put the middle last.

The characters of a slice of texts become classes, and the classes one wavelet matrix:
a bit vector a class bit, with ranks a block of 64.  The units before a place are
the ranks of the classes that end a unit, added up; how many units a text has and
where its two cuts lie are rank queries and bisections on ranks, for all texts of
the slice at once.  Whole texts are read and nothing is shuffled.

Nulls: a null text counts as empty, which stays plain.  A null ``doc_id`` draws as the
text ``null``.  Repeated rows are cut alike and all come out.  A text with a marker
stays plain.  Other columns than ``doc_id`` and ``text`` are not read, whatever their
names.  A text longer than a slice is a slice of its own.  No rows in, no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedcore.llm.common import batch_of, by_bytes

OTHER, NEWLINE, STOP, BLANK = range(4)
#: Classes that end a unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK)}
SLICE = 2 << 20
MARKERS = ("<P>", "<S>", "<M>")

_CLASS = np.zeros(128, np.uint8)
for _chars, _number in (("\n", NEWLINE), (".!?", STOP), (" \t", BLANK)):
    _CLASS[[ord(c) for c in _chars]] = _number


class WaveletMatrix:
    """Ranks of classes below 4 over one sequence."""

    bits = 2

    def __init__(self, codes: np.ndarray) -> None:
        self.levels = []
        for level in reversed(range(self.bits)):
            one = (codes >> level & 1).astype(bool)
            packed = np.zeros((len(codes) >> 6) + 1, "<u8")
            packed.view(np.uint8)[: len(codes) + 7 >> 3] = np.packbits(one, bitorder="little")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(codes) - int(before[-1])
            self.levels.append((packed, before, zeros))
            codes = np.concatenate((codes[~one], codes[one]))

    def rank(self, number: int, at: np.ndarray) -> np.ndarray:
        """How often the class ``number`` comes before each place."""
        low, high = np.zeros(1, np.int64), at
        for level, (packed, before, zeros) in enumerate(self.levels):
            ones = [self._ones(packed, before, x) for x in (low, high)]
            if number >> self.bits - 1 - level & 1:
                low, high = ones[0] + zeros, ones[1] + zeros
            else:
                low, high = low - ones[0], high - ones[1]
        return high - low

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(packed[block] & inside)


class Borders:
    """Unit borders of texts that lie one behind the other."""

    def __init__(self, texts: list[str], unit: str) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint8(OTHER))
        self.matrix, self.ends = WaveletMatrix(classes), UNITS[unit]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.base = self.count(self.start)
        #: Complete units, then those with a last one that has no end.
        self.closed = self.count(self.stop) - self.base
        open_ = (sizes > 0) & (self.count(self.stop) == self.count(np.maximum(self.stop - 1, self.start)))
        self.units = self.closed + open_

    def count(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(number, at) for number in self.ends)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Characters in the first ``units`` units of each text, by bisection on the counts."""
        low, high = self.start.copy(), self.stop.copy()
        while (low < high).any():
            middle = low + high >> 1
            enough = self.count(middle) - self.base >= units
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low - self.start


def draws(key, seed: str) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _apart(markers: tuple[str, str, str]) -> bool:
    """No marker can be found across a border of another one."""
    heads = {m[:1] for m in markers}
    inside = any(c in m[1:] for m in markers for c in heads)
    return "" not in heads and not inside and not any(a != b and a.startswith(b) for a in markers for b in markers) and len(set(markers)) == 3


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64())]
    + [("middle_chars", pa.int64()), ("output", pa.string())]
)


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: str = "7",
              markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every document.

    Of 100 documents, ``rate`` are transformed, and of 100 of those ``spm`` have the
    suffix first.  The two cuts are drawn from the borders of units, ends included.
    """
    if unit not in UNITS or not _apart(markers):
        raise ValueError("an unknown unit, or markers that could be mistaken for each other")
    pre, suf, mid = markers

    def run(rows):
        for batch in by_bytes(rows, "text", SLICE):
            keys = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            drawn = [draws(key, seed) for key in keys]
            borders = Borders(texts, unit)
            cuts = np.sort([[d[0], d[1]] for d in drawn] % (borders.units + 1)[:, None], axis=1)
            first, second = (borders.after(cuts[:, i]).tolist() for i in (0, 1))
            out = []
            for key, text, n, d, i, j in zip(keys, texts, borders.units.tolist(), drawn, first, second):
                if not text or d[2] % 100 >= rate or any(m in text for m in markers):
                    out.append((key, n, "plain", None, None, text))
                elif d[3] % 100 < spm:
                    out.append((key, n, "spm", i, j - i, f"{suf}{text[j:]}{pre}{text[:i]}{mid}{text[i:j]}"))
                else:
                    out.append((key, n, "psm", i, j - i, f"{pre}{text[:i]}{suf}{text[j:]}{mid}{text[i:j]}"))
            yield batch_of(_OUT, *zip(*out))

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def restored(output: str | Column, form: str | Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from output and form: each marker is in an output once."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
