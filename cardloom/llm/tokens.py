"""Token ids of many texts by the tokenizers library, sharing the work on repeated words.

The library encodes each distinct piece of text once in a worker: its result for a text is the
concatenation of its results for the text's pieces wherever the pieces meet at boundaries that
the vocabulary's own pre-tokenizer also makes. For the two kinds of vocabulary in ``SHARED``
those are single white space characters, and full stops and commas behind a character that the
vocabulary's own normalizer and pre-tokenizer part from them (``tests/llm/test_tokens.py``
compares with whole texts); a text with longer runs of white space, with stops and commas behind
other marks, or with one of the vocabulary's own special tokens is encoded whole. Under any other
vocabulary every text is.

Pieces are found among those remembered as numpy arrays over the texts' UTF-8 bytes: a hash
leads to a slot, and all bytes are compared.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from cardloom.llm.common import text_buffer

#: Pieces that a worker remembers, of about 100 bytes each; with more, it goes on with those that came again.
REMEMBERED = 600_000
#: Words of eight bytes of a remembered piece at most; longer ones are encoded once for each call.
WORDS = 4
#: Slots in which a piece is sought; pieces looked up at a time; characters remembered with whether they join a stop.
PROBES, RUN, MOST_CHARS = 32, 1 << 18, 50_000
_SPACE = re.compile(r"\s")
_PLAIN = frozenset(string.ascii_letters + string.digits + "\n")
#: Bytes at which a piece begins, and white space beside those.
CUTS, OTHER_SPACES = (np.isin(np.arange(256), list(x)) for x in (b" \n.,", b"\t\v\f\r\x1c\x1d\x1e\x1f"))
#: Masks of the first 0 to 8 bytes, and odd factors of the hashes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)

# --- fixed values: the settings of vocabulary files under which pieces can be shared ---------
#: (normalizer, pre-tokenizer), and whether spaces are part of the ids.
SHARED = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, True),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        False,
    ),
]
# --- end of fixed values -------------------------------------------------------------------


class _Growing:
    """An array that is added to without copying it every time."""

    def __init__(self, kind: type, *shape: int):
        self.all = np.zeros((1 << 12, *shape), dtype=kind)
        self.held = self.all[:0]

    def add(self, more: np.ndarray) -> None:
        n = len(self.held)
        if n + len(more) > len(self.all):
            self.all = np.concatenate([self.held, np.zeros((n // 2 + 2 * len(more), *self.all.shape[1:]), dtype=self.all.dtype)])
        self.all[n : n + len(more)] = more
        self.held = self.all[: n + len(more)]

    def cut(self, n: int) -> None:
        """Keep the first ``n``."""
        self.held = self.all[:n]


class Encoder:
    """Ids of texts under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        kinds = [spaced for normal, cut, spaced in SHARED if (about["normalizer"], about["pre_tokenizer"]) == (normal, cut)]
        plain = about["model"]["type"] == "BPE" and not about["model"].get("dropout") and not about["post_processor"] and not about["truncation"] and not about["padding"]
        self.shares = bool(kinds) and plain
        self.spaced = bool(kinds and kinds[0])
        self.special = [t["content"] for t in about["added_tokens"]]
        self.joins: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.flat, self.start, self.size, self.mark, self.hash, self.again = (_Growing(t) for t in (np.uint32, np.int64, np.int32, np.uint8, np.uint64, bool))
        self.key = _Growing(np.uint64, WORDS)
        self.slots = np.full(1 << 15, -1, dtype=np.int32)

    def _thin(self) -> None:
        """Forget the pieces that have not come again, and older ones beyond half of what may be held."""
        kept = np.flatnonzero(self.again.held)[-(REMEMBERED // 2) :]
        old = self.flat.held, self.start.held[kept], self.size.held[kept], self.mark.held[kept], self.hash.held[kept], self.key.held[kept]
        self.forget()
        flat, start, size, mark, hashes, key = old
        place = np.cumsum(size, dtype=np.int64) - size
        self.flat.add(flat[np.repeat(start - place, size) + np.arange(size.sum())])
        for to, more in ((self.start, place), (self.size, size), (self.mark, mark), (self.hash, hashes), (self.key, key), (self.again, np.zeros(len(kept), dtype=bool))):
            to.add(more)
        self._place(0)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, straight from the library."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joins(self, last: str) -> bool:
        """Whether the vocabulary makes one token's piece of this character, as it normalizes it, and a stop behind it."""
        if last not in self.joins:
            text, normal = last + ".", self.tokenizer.normalizer
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)
            if len(self.joins) >= MOST_CHARS:
                self.joins = {}
            self.joins[last] = cut[-1][0] != "."
        return self.joins[last]

    def _marks(self, pieces: list[str]) -> np.ndarray:
        """Of each piece, 1: no piece of its own; 2: ends in a mark that would join a stop; 4: begins with a stop or comma."""
        marks = np.zeros(len(pieces), dtype=np.uint8)
        for i, piece in enumerate(pieces):
            plain = piece[-1] in _PLAIN
            if not plain or piece[0] in ".," or not piece.isascii():
                alone = self.spaced and (piece == " " or not piece.isascii() and _SPACE.search(piece, 1) is not None)
                marks[i] = alone + 2 * (not plain and self._joins(piece[-1])) + 4 * (piece[0] in ".,")
        return marks

    def _find(self, key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece that is remembered, else -1."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        left, place = np.arange(len(hashes)), (hashes >> np.uint64(64 - (len(self.slots) - 1).bit_length())).astype(np.int64)
        for _ in range(PROBES):
            number = self.slots[place]
            held = number >= 0
            if not held.all():
                left, place, number = left[held], place[held], number[held]
            if not len(left):
                break
            same = (self.key.held[number] == key[left]).view(np.uint32)[:, 0] == 0x01010101
            found[left[same]] = number[same]
            left, place = left[~same], (place[~same] + 1) & (len(self.slots) - 1)
        return found

    def _place(self, first: int) -> None:
        """Give the pieces from number ``first`` on their slots; a piece that finds none near is not found again."""
        if 2 * len(self.hash.held) > len(self.slots):
            self.slots, first = np.full(1 << (4 * len(self.hash.held)).bit_length(), -1, dtype=np.int32), 0
        number = np.arange(first, len(self.hash.held), dtype=np.int32)
        place = (self.hash.held[first:] >> np.uint64(64 - (len(self.slots) - 1).bit_length())).astype(np.int64)
        for _ in range(PROBES):
            free = self.slots[place] < 0
            self.slots[place[free]] = number[free]
            rest = self.slots[place] != number
            number, place = number[rest], (place[rest] + 1) & (len(self.slots) - 1)

    def _append(self, pieces: list[str]) -> None:
        """Number the pieces on and hold their ids."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start.add(len(self.flat.held) + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(np.fromiter(chain.from_iterable(ids), np.uint32, size.sum()))
        self.mark.add(self._marks(pieces))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin; one more at the end); null texts are empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.shares:
            own = self.whole([t or "" for t in column.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *own]), np.cumsum([0, *map(len, own)])
        raw, at = text_buffer(column)
        odd = self._odd(raw, at)
        begins = CUTS[raw]
        begins[1:] |= raw[:-1] == 10
        begins[at[:-1][at[:-1] < at[1:]]] = True
        if odd.any():
            begins[np.repeat(odd, np.diff(at))] = False
        start = np.flatnonzero(begins)
        count = np.diff(np.searchsorted(start, at))
        of = np.repeat(np.arange(len(count)), count)
        length = np.minimum(np.append(start[1:], len(raw)), at[of + 1]) - start if len(start) else start
        if len(self.hash.held) > REMEMBERED:
            self._thin()
        index = self._numbers(raw, start, length)
        marks = self.mark.held[index]
        odd[of[(marks & 1) > 0]] = True
        odd[of[1:][((marks[:-1] & 2) > 0) & ((marks[1:] & 4) > 0) & (of[1:] == of[:-1])]] = True
        size = self.size.held[index]
        place = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat.held[np.repeat(self.start.held[index] - place[:-1], size) + np.arange(place[-1])]
        begin = place[np.concatenate(([0], np.cumsum(count)))]
        if len(self.size.held) > (n := len(self.hash.held)):  # long pieces are not kept
            self.flat.cut(int(self.start.held[n]))
            for x in (self.start, self.size, self.mark):
                x.cut(n)
        if odd.any():
            parts = [ids[a:b] for a, b in zip(begin, begin[1:], strict=False)]
            rows = np.flatnonzero(odd)
            for t, own in zip(rows.tolist(), self.whole([t or "" for t in column.take(pa.array(rows)).to_pylist()]), strict=True):
                parts[t] = own
            ids, begin = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, begin

    def _odd(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that their bytes show to be encoded whole."""
        odd = np.zeros(len(at) - 1, dtype=bool)
        if not len(raw):
            return odd
        data = raw.tobytes()
        for mark in ("\x00", *self.special):
            sought, k = mark.encode(), -1
            while (k := data.find(sought, k + 1)) >= 0:
                t = int(np.searchsorted(at, k, side="right")) - 1
                odd[t] = True
                k = int(at[t + 1]) - 1  # go on behind this text
        if self.spaced:
            full = np.flatnonzero(at[:-1] < at[1:])
            odd[full[CUTS[raw[at[full]]] | (raw[at[full + 1] - 1] == 10)]] = True
            runs = np.flatnonzero(OTHER_SPACES[raw])
            runs = np.concatenate([runs, np.flatnonzero((raw[:-1] == 10) & CUTS[raw[1:]])])
            odd[np.searchsorted(at, runs, side="right") - 1] = True
        return odd

    def _numbers(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each piece among those remembered, to which the new ones are added."""
        padded = np.zeros(len(raw) + 8 * WORDS + 8, dtype=np.uint8)
        padded[: len(raw)] = raw
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        index = np.empty(len(start), dtype=np.int64)
        apart = [np.flatnonzero(length > 8 * WORDS)]
        for lo in range(0, len(start), RUN):
            begin, n = start[lo : lo + RUN], length[lo : lo + RUN]
            key = np.empty((len(begin), WORDS), dtype=np.uint64)
            hashes = np.zeros(len(begin), dtype=np.uint64)
            for w in range(WORDS):
                key[:, w] = eight[begin + 8 * w] & KEEP[np.clip(n - 8 * w, 0, 8)]
                hashes = (hashes ^ key[:, w]) * FACTORS[w]
                hashes ^= hashes >> np.uint64(32)
            hashes *= FACTORS[0]
            own = self._find(key, hashes)
            self.again.held[own[own >= 0]] = True
            missing = np.flatnonzero((own < 0) & (n <= 8 * WORDS))
            if len(missing):
                _, first, again = np.unique(hashes[missing], return_index=True, return_inverse=True)
                new = missing[first]
                own[missing] = len(self.hash.held) + again
                apart.append(lo + missing[(key[missing] != key[new[again]]).any(1)])  # of one hash, but another piece
                self._append(self._cut(padded, begin[new], n[new]))
                self.key.add(key[new])
                self.hash.add(hashes[new])
                self.again.add(np.bincount(again, minlength=len(new)) > 1)
                self._place(len(self.hash.held) - len(new))
            index[lo : lo + RUN] = own
        rest = np.concatenate(apart)
        if len(rest):
            cut = self._cut(padded, start[rest], length[rest])
            numbers = {piece: len(self.size.held) + k for k, piece in enumerate(dict.fromkeys(cut))}
            index[rest] = np.fromiter(map(numbers.get, cut), np.int64, len(cut))
            self._append(list(numbers))
        return index

    @staticmethod
    def _cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[str]:
        text = memoryview(data)
        return [str(text[a : a + n], "utf-8") for a, n in zip(start.tolist(), length.tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
