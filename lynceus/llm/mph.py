"""Minimal perfect hashing of distinct 64-bit keys, by levels of bits, for numpy.

Each level hashes the keys that are left into a bit array; a key alone in its cell sets the cell's bit and is
placed, the others go to the next level.  A key's index is the number of set bits before its own, so n keys have
the indices 0 to n - 1, in about four bits a key.  A key that was never placed may get any index or none: keep
the keys in order of their indices and compare (``Hashed``).
"""

from __future__ import annotations

import numpy as np

from .words import mix

#: Cells for each key that is left, at every level.
GAMMA = 1.5


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def built(keys: np.ndarray) -> tuple[list[int], bytes]:
    """The size of every level and the packed bits of all, for distinct keys."""
    sizes, parts, level = [], [], 0
    while len(keys):
        size = max(8, int(len(keys) * GAMMA))
        at = _cells(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        keys, level = keys[~alone[at]], level + 1
    return sizes, np.packbits(np.concatenate([np.zeros(0, bool), *parts])).tobytes()


class Hashed:
    """Indices of keys, verified against the keys themselves where these are given in order of their indices."""

    def __init__(self, sizes: list[int], bits: bytes, keys: np.ndarray | None = None):
        self.sizes, self.keys = sizes, keys
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; -1 for a key that is none of the set's, as far as its bits or the keys show."""
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            cell = first + _cells(keys[left], level, size)
            hit = self.bits[cell]
            out[left[hit]] = self.rank[cell[hit]]
            left, first = left[~hit], first + size
        if self.keys is not None and len(self.keys):
            out[(out >= 0) & (self.keys[np.maximum(out, 0)] != keys)] = -1
        return out
