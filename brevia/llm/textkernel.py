"""Vectorised word kernel shared by the text operators.

Arrow string columns are read as raw UTF-8 bytes. Word borders, word hashes and shingle hashes come from
numpy passes over the bytes; no Python string is made per word. Work goes in slices of about ``SLICE``
bytes of text so that memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply), element by element; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(salt * 1_000_003)) * U(_STEP))


_BYTE = seeds(256, 7)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: The contract's white space, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to lower case; every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0..p^(n-1) and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``size`` bytes; at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def segments(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not ``space``, and the words of each row."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets) - 1, np.int64)
    ws = space[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = ~ws
    end = begin.copy()
    begin[1:] &= ws[:-1] | first[1:n]
    end[:-1] &= ws[1:] | first[1:n]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.diff(np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:stop] of each run: a polynomial with random byte values, then mixed with the length."""
    if len(start) == 0:
        return np.zeros(0, U)
    p, inv = powers(len(data) + 1)
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[stop] - c[start]) * inv[start] + (stop - start).astype(U) * U(_STEP))


def shingles(word: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs within rows, and their number by row; a shorter row gives its whole sequence as one."""
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, U), n
    at = np.cumsum(counts) - counts
    pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    last = len(word) - 1
    h = np.zeros(total, U)
    for i in range(k):
        h = h * U(_P) + word[np.minimum(pos + i, last)]
    h = mix(h)
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        x = U(0)
        for w in word[at[r] : at[r] + counts[r]]:
            x = mix(np.array([x], U) * U(_P) + w + U(1))[0]
        h[(np.cumsum(n) - n)[r]] = x
    return h, n


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and the words of each row."""
    low = LOWER[data]
    start, stop, counts = segments(low, offsets)
    return hashes(low, start, stop), start, stop, counts


class HashIndex:
    """Open-addressing table from 64-bit hashes to 0, 1, 2, ... with vectorised probes."""

    def __init__(self, bits: int = 16) -> None:
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.key = np.zeros(1 << bits, U)
        self.val = np.full(1 << bits, -1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is unknown."""
        mask = (1 << self.bits) - 1
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        val = self.val[slot]
        out = np.where((val >= 0) & (self.key[slot] == h), val, -1)
        todo = np.flatnonzero((val >= 0) & (out < 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            v, same = self.val[slot[todo]], self.key[slot[todo]] == h[todo]
            out[todo[(v >= 0) & same]] = v[(v >= 0) & same]
            todo = todo[(v >= 0) & ~same]
        return out

    def add(self, new: np.ndarray) -> None:
        """Distinct unknown hashes get the next indexes, in order."""
        if (self.n + len(new)) * 2 > 1 << self.bits:
            old, vals = self.key[self.val >= 0], self.val[self.val >= 0]
            bits = self.bits
            while (self.n + len(new)) * 2 > 1 << bits:
                bits += 1
            self._make(bits)
            self._put(old, vals)
        self._put(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
        self.n += len(new)

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.val[slot[todo]] < 0
            want = todo[free]
            # of several that want one slot, the last write stays; the others go on
            self.val[slot[want]] = vals[want]
            self.key[slot[want]] = h[want]
            lost = np.ones(len(todo), bool)
            lost[free] = self.val[slot[want]] != vals[want]
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & mask


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[i] .. start[i]+length[i]-1 of all i, one after another."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
