"""Minimal perfect hashing of 64-bit keys: levels of bit arrays, with stored fingerprints.

At each level the keys left over are hashed into twice as many places; a key alone in its place
sets the bit there and is done, the others go on. A key's number is the count of set bits
before its own, so n keys get the numbers 0 to n - 1 in about three levels a look-up. Each
number has a 32-bit fingerprint of its key, by which keys that were never indexed are told
(but for one in four thousand million).
"""

from __future__ import annotations

import numpy as np

from cardloom.llm.bytewords import mix

LEVELS = 48
_SEED = 0x9E3779B97F4A7C15


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.astype(np.uint64) + np.uint64(_SEED * (seed + 1) & 0xFFFFFFFFFFFFFFFF)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Numbers of distinct keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, prints: np.ndarray):
        self.sizes, self.words, self.prints = sizes, words, prints  # bits of each level; all levels' bits; by number
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Index distinct keys."""
        left, sizes, levels = np.asarray(keys, dtype=np.int64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys must be distinct")
            size = -(-2 * len(left) // 64) * 64
            place = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        found = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.zeros(len(keys), np.uint32))
        found.prints[found.number(keys)] = fingerprints(np.asarray(keys))
        return found

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for a key that is not indexed, any number or -1."""
        keys = np.asarray(keys, dtype=np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            place = base + (_hash(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[place >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 where the fingerprint differs."""
        number = self.number(keys)
        known = number >= 0
        known[known] = self.prints[number[known]] == fingerprints(np.asarray(keys)[known])
        return np.where(known, number, -1)

    def parts(self) -> tuple[dict, list[bytes]]:
        return {"sizes": self.sizes, "keys": len(self.prints)}, [self.words.astype("<u8").tobytes(), self.prints.astype("<u4").tobytes()]
