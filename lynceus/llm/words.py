"""Whitespace words of many texts at once, as numpy arrays.

Words are the runs of bytes other than space and \\x09-\\x0D, so a text's words are those of
``bytes.split()``.  Hashes are multilinear over 64-bit words: equal words have equal hashes in every
task, and two seeds give 128 bits where results must be exact.
"""

from __future__ import annotations

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS: dict[int, tuple] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(seed: int, n: int) -> tuple:
    """Byte values, and powers of an odd base and of its inverse modulo 2**64, up to n."""
    if seed not in _SEEDS or len(_SEEDS[seed][1]) < n:
        rng = np.random.default_rng(seed)
        table = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        base = int(rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
        size = max(n, 1 << 20)
        ahead, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        ahead[0] = back[0] = 1
        _SEEDS[seed] = table, np.multiply.accumulate(ahead), np.multiply.accumulate(back)
    return _SEEDS[seed]


class Words:
    """The words of some texts: ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data
        solid = ~WHITE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        at = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.first = np.searchsorted(self.start, at)

    def hashes(self, seed: int) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end, seed)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    table, ahead, back = _powers(seed, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * ahead[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start])


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = np.random.default_rng(seed + 1000).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * factors[k]
    ends = np.repeat(first[1:], np.diff(first))[:n]  # of the text that holds each word
    inside = np.arange(n) + size <= ends
    at = np.flatnonzero(inside)
    return mix(out[at]), at
