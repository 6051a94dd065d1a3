"""Vectorised words, hashes and windows over the byte buffers of Arrow text columns.

Everything here runs inside tasks on slices of at most ``SLICE`` bytes (or one document, if longer),
so its memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One random odd 64-bit number for each byte value, the same in every process.
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse, kept for the next slice."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 200_000), _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE + 200_000:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit with probability about a half."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Docs:
    """A run of documents: one byte buffer, and where each document starts and ends in it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Prefix sums from which any window's hash follows by one subtraction and one product."""
        data = _LOWER[self.data] if lower else self.data
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data)), out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, index of the first word of each document, with the total at the end)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        solid = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        edge[self.ends] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        end = solid
        stop = end.copy()
        stop[:-1] &= ~end[1:] | edge[1:n]
        begins, stops = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return begins, stops, np.append(np.searchsorted(begins, self.starts), len(begins))


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) from prefix sums; equal bytes give equal hashes anywhere."""
    return mix((hashes[ends] - hashes[starts]) * _power("down", int(starts.max()) + 1 if len(starts) else 1)[starts])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * np.uint64((_BASE * (2 * k + 3) ** 5) & _MASK | 1)
    return mix(total)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Docs]:
    """Cut a text column into runs of whole documents; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        empty = np.asarray(column.is_null())
        ends[empty] = starts[empty]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        lo, hi = int(at[i]), int(at[j])
        yield Docs(raw[lo:hi], starts[i:j] - lo, ends[i:j] - lo, i)
        i = j
