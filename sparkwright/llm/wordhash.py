"""Vectorised word boundaries and word hashes of many texts at once.

Words are maximal runs of bytes other than space and 0x09-0x0D. All work is on
UTF-8 bytes with numpy. Hashes have 64 bits and take eight bytes at a time through
a bijective mixer, so that the chance of two different words of a corpus meeting is
about n*n/2**65 (under 1e-5 at ten million words).
"""

from __future__ import annotations

import numpy as np
import xxhash

from sparkwright.llm.shared import mix64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Keeps the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Slices longer than this are hashed one by one.
LONG = 512


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of ``data``."""
    n = end - start
    out = mix64(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    if not len(n):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    at = np.flatnonzero((n > 0) & (n <= LONG))
    for k in range(0, LONG, 8):
        if not len(at):
            break
        lane = wide[start[at] + k].view(np.uint64).ravel() & _FIRST[np.minimum(n[at] - k, 8)]
        with np.errstate(over="ignore"):
            out[at] = mix64((out[at] ^ lane) * np.uint64(0x9E3779B97F4A7C15))
        at = at[n[at] > k + 8]
    for i in np.flatnonzero(n > LONG):
        out[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[start[i] : end[i]]))
    return out


class Words:
    """Word boundaries of rows lo..hi of a batch: ``start`` and ``end`` (bytes
    from the first of these rows), ``row`` (from 0), ``first`` (the first word of
    each row, and the number of words at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = (offsets - base).astype(np.int64)
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACE[self.data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        # A row that ends without a space still ends its word.
        begins[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = slice_hashes(self.data, self.start, self.end)
        return self._hash

    def grams(self, size: int) -> np.ndarray:
        """The hash of ``size`` words from each word on; those that pass a row's
        end mean nothing."""
        h = self.hash
        out = np.zeros(len(h), np.uint64)
        n = len(h) - size + 1
        if n > 0:
            with np.errstate(over="ignore"):
                for k in range(size):
                    out[:n] = mix64(out[:n] * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return out
