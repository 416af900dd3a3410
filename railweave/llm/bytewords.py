"""Words, word hashes and window hashes of many texts at once, as numpy arrays over UTF-8 bytes.

A batch of texts is one byte array.  Word borders come from a table of 256 entries, and hashes from
prefix sums of ``table[byte] * BASE**position`` (wrapping 64-bit integers), so that no Python code runs
per word.  Whitespace is x20 and x09-x0D; all other bytes belong to words, which is the same as
splitting code points, as these six are single bytes in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_TABLES = np.random.RandomState(20240229).randint(0, 1 << 63, size=(2, 256), dtype=np.int64).astype(np.uint64)
_TABLES = _TABLES * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and every byte of a longer code point.
LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = LETTER[ord("A"):ord("Z") + 1] = LETTER[0x80:] = True
_LOWER = np.arange(256)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of ``n_docs`` texts: text number, byte span inside ``data`` and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def firsts(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) in pieces of at most ``limit`` bytes or one text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False,
          table: int = 0) -> Words:
    """Words of the texts in ``data``; with ``letters``, runs of letters instead of runs of non-spaces."""
    inside = (LETTER if letters else ~SPACE)[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        at = offsets[:-1][filled]
        begins[at] = inside[at]
        at = offsets[1:][filled] - 1
        ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(data, offsets, doc, start, end, span_hash(data, start, end, lower, table))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False,
              table: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever it stands."""
    up, down = _power(len(data) + 1)
    values = _TABLES[table][_LOWER] if lower else _TABLES[table]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``n`` consecutive words that lies in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:])
    return first, range_hash(hashes, first, first + n)


def range_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each range of word hashes, the same wherever it stands."""
    up, down = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
