"""Vectorised words: boundaries and 64-bit hashes of all words of a batch, by numpy over the raw bytes.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.
Its hash is a polynomial over random byte values modulo 2**64, then mixed.  Two
different words share a hash with a chance of about 2**-63 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes hashed in one go; the power tables are this long.
BLOCK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C13)
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


@dataclass
class Words:
    """start and end: byte places in the joined texts; hash; first: the index of each text's first word, and one more."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[bytes], bare: bool = False) -> Words:
    """All words of the texts, in order; bare: ASCII punctuation separates words as space does."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    # one space after each text keeps words of neighbours apart
    raw = b" ".join(texts) + b" "
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    inside = ~(_PLAIN if bare else _SPACE)[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        a = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        b = int(end[hi - 1])
        up, down = _tables(max(BLOCK, b - a))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[data[a:b]] * up[: b - a], out=total[1:])
        s = start[lo:hi] - a
        hashes[lo:hi] = (total[end[lo:hi] - a] - total[s]) * down[s]
        lo = hi
    return Words(data, start, end, mixed(hashes), np.searchsorted(start, offsets))


def rolled(h: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """A hash for each place of the words at ``offsets`` from it, in order; as long as whole windows fit."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed * 2 + 1))
    for k in offsets:
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(31)
    return out
