"""Vectorised word and character codes over blocks of concatenated texts.

A block is a run of documents of about one megabyte (a longer document is a
block of its own), held as one byte array plus offsets, so that hashing costs a
few numpy passes instead of a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _byte_table(is_word) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if is_word(b):
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table


#: Words of letters, digits and non-ASCII bytes, A-Z lower-cased; other bytes separate.
ALNUM = _byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: Words between ASCII white space, A-Z lower-cased.
SOLID = _byte_table(lambda b: b not in (32, 9, 10, 11, 12, 13) and b != 0)


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of ``col`` and the offsets of each."""
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(col: pa.Array, limit: int = BLOCK_BYTES, most: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets within the block) for runs of at most ``most`` documents."""
    data, offsets = raw(col)
    first, n = 0, len(col)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, first + most, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _powers(n: int, base: np.uint64, cache: dict = {}) -> np.ndarray:  # noqa: B006 - grows to the longest block seen
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES * 2)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= BLOCK_BYTES * 16:
            cache[int(base)] = have
    return have[:n]


class Words:
    """The words of a block: where each starts and ends, and hashes of byte ranges."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.folded = table[data]
        self.offsets = offsets
        solid = self.folded != 0
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets[offsets < len(data) + 1]] = True
            before = np.empty(len(data), bool)
            before[0] = False
            before[1:] = solid[:-1]
            before &= ~edge[:-1]
            after = np.empty(len(data), bool)
            after[-1] = False
            after[:-1] = solid[1:]
            after &= ~edge[1:]
            self.starts = np.flatnonzero(solid & ~before)
            self.ends = np.flatnonzero(solid & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        #: Words of document i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((self.folded.astype(np.uint64) + np.uint64(1)) * _powers(n, _ODD), out=self._sums[1:])
        self._unshift = _powers(n + 1, _INV)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte range (of each word, by default)."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        return mix((self._sums[ends] - self._sums[starts]) * self._unshift[starts], salt)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``, also where that is empty.

    Each sum depends on its own values alone, to the last bit, so a text scores
    the same whatever stands beside it.
    """
    values = values[: first[-1]].astype(np.float64, copy=False)
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


def no_nulls(col: pa.Array) -> pa.Array:
    return pc.fill_null(col, "") if col.null_count else col
