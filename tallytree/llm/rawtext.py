"""Vectorised views of raw text bytes inside a task: words, word hashes, shingles, chunks of rows."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Java regular expression of white space; a word is a longest run of anything else.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes and rows of text that one vectorised step looks at; a longer row is a step of its own.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 2048

_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Tables that a worker process keeps from task to task; functions that travel by value bring no state of their own.
_KEPT = "tallytree_llm_kept_tables"


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; the longest table made so far is kept."""
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    have = kept.get(str(base))
    if have is None or have.size < n:
        size = max(n, CHUNK_BYTES + 65536)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = kept[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


class RollingHash:
    """Hashes of any byte ranges of one buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        self._sums = np.zeros(data.size + 1, dtype=np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(_RADIX, data.size)
        np.cumsum(terms, out=self._sums[1:])
        self._inverse = powers(_RADIX_INVERSE, data.size + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every range of ``size`` bytes."""
        return mixed((self._sums[size:] - self._sums[:-size]) * self._inverse[: self._sums.size - size])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values: running minima from both ends of blocks."""
    n = values.size - width + 1
    pad = -values.size % width
    blocks = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64))).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def places_of_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of every ``width`` consecutive hashes stands, the leftmost of equal ones.

    The lowest bits of a hash give way to its place, so it is the order of the upper bits that counts.
    """
    bits = np.uint64(max(1, int(hashes.size).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(hashes.size, dtype=np.uint64)
    return (sliding_min(ranked, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def row_chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of consecutive rows of about ``limit`` bytes, CHUNK_ROWS rows at most."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit or i - start == CHUNK_ROWS:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> list[bytes]:
    """The rows as bytes; a missing text is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


class WordGrid:
    """The words of some texts: ``row`` of each word, where it starts and ends in ``data``."""

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text_start = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.text_end = ends.astype(np.int64) - 1
        solid = ~_IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid)).astype(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.row = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.texts)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1]))

    def hashes(self) -> np.ndarray:
        return RollingHash(self.data).of(self.start, self.end)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every run of ``size`` words; a shorter text is one run of all its words."""
        word = self.hashes()
        n = word.size
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = self.first[self.row] + self.count[self.row]
        place = np.arange(n)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            inside = place + k < last
            term = np.zeros(n, dtype=np.uint64)
            term[: max(0, n - k)] = word[k:]
            out = np.where(inside, (out + term) * np.uint64(_RADIX), out)
        whole = (place + size <= last) | (place == self.first[self.row])
        return self.row[whole], mixed(out[whole])


def batches(rows: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES):
    """(batch slice, its texts as bytes) for slices of about ``limit`` bytes."""
    for batch in rows:
        texts = utf8(batch.column(batch.schema.get_field_index(text)))
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        for a, b in row_chunks(sizes, limit):
            yield batch.slice(a, b - a), texts[a:b]
