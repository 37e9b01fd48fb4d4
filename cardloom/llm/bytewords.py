"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters; A-Z count as a-z.
Hashes are 64-bit: equal words always have equal hashes, other words differ but for a chance
of about 2**-64 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cardloom.llm.common import text_buffer

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones((2, 1), dtype=np.uint64)

#: Odd factors that make a hash of several words depend on their order.
PLACES = np.array([(0xBF58476D1CE4E5B9 * (2 * k + 1) ** 5) | 1 for k in range(64)], dtype=object)
PLACES = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in PLACES], dtype=np.uint64)


def _powers_up_to(n: int) -> np.ndarray:
    """Powers of the base, and of its inverse, mod 2**64."""
    global _powers
    if _powers.shape[1] < n + 1:
        rows = np.empty((2, n + 1), dtype=np.uint64)
        rows[:, 0] = 1
        rows[0, 1:], rows[1, 1:] = _BASE, _INVERSE
        _powers = np.multiply.accumulate(rows, axis=1)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    raw: np.ndarray  # lower-cased bytes of all texts
    start: np.ndarray  # of each word, in raw
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text; one more at the end
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_at(self, i: int, n: int) -> bytes:
        """``n`` words from word ``i`` on, with single spaces between."""
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def words(column: pa.Array) -> Words:
    """The words of each text of a string column."""
    raw, offsets = text_buffer(column)
    return words_of(raw, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[raw]
    inside = IN_WORD[low]
    edge = np.empty(len(low) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    if len(low):
        runs = inside[at[:-1]]
        start, end = at[:-1][runs], at[1:][runs]
    else:
        start = end = np.zeros(0, dtype=np.int64)
    powers = _powers_up_to(len(low))
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[0, : len(low)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers[1, start])
    return Words(low, start, end, np.searchsorted(start, offsets), h)


def runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words that begin at each word."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += h[k : k + m] * PLACES[k]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles, text after text, and the index of each text's first.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    count = np.diff(w.first)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(at[-1], dtype=np.uint64)
    full = runs_hash(w.hash, n)
    begin = np.repeat(w.first[:-1] - at[:-1], number) + np.arange(at[-1])
    long = np.repeat(count >= n, number)
    out[long] = full[begin[long]]
    for t in np.flatnonzero((count > 0) & (count < n)):
        s = w.hash[w.first[t] : w.first[t + 1]]
        out[at[t]] = mix((s * PLACES[: len(s)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0]
    return out, at
