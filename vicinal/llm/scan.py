"""Vectorised passes over the bytes of many texts at once: words, rolling hashes, hashes of word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space between words as a table over bytes; A-Z to a-z likewise.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
#: Base of the polynomial hash (3 mod 8, so that swapped bytes keep their distance), its inverse mod 2**64, a random value for each byte.
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        grown = [np.full(size, x, dtype=np.uint64) for x in (BASE, INVERSE)]
        for g in grown:
            g[0] = 1
        _POWERS[:] = [np.cumprod(g) for g in grown]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any substring of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = BYTE[data]
        terms *= up[:-1]
        np.cumsum(terms, out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hashes of all substrings of a length, in order."""
        h = self.sums[length:] - self.sums[:-length]
        h *= self.down[: len(h)]
        h += U(length)
        return mix(h)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def chunks(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: index of the first, bytes, offsets of the texts (one more than texts)."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if n and raw.buffers()[2] and raw.buffers()[2].size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
        first = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words, and the index of each text's first word (one more than texts)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words, lower-cased in A-Z; of all its words if fewer."""
    data = LOWER[data]
    start, stop, first = words(data, offsets)
    if not len(start):
        return [np.zeros(0, dtype=np.uint64)] * (len(offsets) - 1)
    own = Rolling(data).of(start, stop)
    count = np.diff(first)
    run = own.copy()
    for j in range(1, k):
        run[: len(own) - j] = mix(run[: len(own) - j] * U(0x9DDFEA08EB382D69) + own[j:])
    out = []
    for d, n in enumerate(count.tolist()):
        a = int(first[d])
        if n >= k:
            out.append(np.unique(run[a : a + n - k + 1]))
        elif n:
            h = own[a : a + 1]
            for j in range(1, n):
                h = mix(h * U(0x9DDFEA08EB382D69) + own[a + j : a + j + 1])
            out.append(mix(h + U(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
