"""Leaf blocks of a page: runs of text between block-level tags, with what is known of each.

A block's vectors are its tag path (open elements, and hashed words of their class, id and role
attributes), its hashed words, and a few measures of its text and place. What is open is counted,
not copied, and the last open element of each name is known: time and memory are linear in a
page, however deep its elements nest and however many are never closed.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cardloom.llm import bytewords

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

SKIPPED = frozenset("script style noscript template svg math iframe object head title select textarea button datalist canvas audio video".split())
#: What has no end holds the rest of the page.
_RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: A start tag of the first kind ends an open element of the second, within the nearest of the third.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
PATH_TAGS = "html body div article section main header footer nav aside form fieldset ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary address dialog a label".split()
_PATH = {t: i for i, t in enumerate(PATH_TAGS)}
NAMES, WORDS, MEASURES = 128, 48, 14
FEATURES = 2 * len(PATH_TAGS) + NAMES + WORDS + MEASURES


@dataclass
class Block:
    text: str
    tags: frozenset[int]  # open elements, by their places in PATH_TAGS
    inner: int | None  # the innermost that is not inline
    depth: int
    names: frozenset[int]  # hashed words of the attributes of the open elements
    linked: int = 0  # characters in links


@lru_cache(maxsize=4096)
def _names(attributes: str) -> frozenset[int]:
    found = set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for w in _NAME_WORD.findall(a or b or c):
            found.add(zlib.crc32(w.lower().encode()) % NAMES)
    return frozenset(found)


class _Open:
    """The open elements of a page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[int]]] = []
        self.at: dict[str, list[int]] = {}  # places in the stack, by tag
        self.solid: list[int] = []  # places of elements that are not inline
        self.named: Counter[int] = Counter()
        self.known: tuple[frozenset[int], frozenset[int]] | None = None

    def push(self, tag: str, names: frozenset[int]) -> None:
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names))
        self.named.update(names)
        self.known = None

    def close(self, k: int) -> None:
        """Close all from place ``k`` on."""
        while len(self.stack) > k:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            self.named.subtract(names)
        self.known = None

    def last(self, *tags: str) -> int:
        """The place of the innermost of some elements, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def block(self, text: str, linked: int) -> Block:
        if self.known is None:
            self.known = frozenset(_PATH[t] for t, held in self.at.items() if held and t in _PATH), frozenset(k for k, n in self.named.items() if n > 0)
        inner = _PATH.get(self.stack[self.solid[-1]][0]) if self.solid else None
        return Block(text, self.known[0], inner, len(self.stack), self.known[1], min(linked, len(text)))


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    held = _Open()
    pieces: list[str] = []
    endless: set[str] = set()  # skipped elements that nothing ends any more
    linked, skip_until, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(held.block(text, linked))
        linked = 0

    for m in _TOKEN.finditer(page, 0, page.rfind(">") + 1):  # no tag ends behind that
        if m.start() < skip_until:
            continue
        if m.start() > at:
            raw = page[at : m.start()]
            pieces.append(raw)
            if held.at.get("a"):
                linked += len(raw.strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                at = len(page)
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif ending:
                k = held.last(tag)
                if k >= 0 and (not held.solid or held.solid[-1] < k):
                    held.close(k)
            elif tag not in VOID and not attributes.endswith("/"):
                held.push(tag, _names(attributes))
            continue
        flush()
        if not ending and tag in SKIPPED and not attributes.endswith("/"):
            # nothing of it is text: go on behind its end
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if end:
                at = skip_until = end.end()
            elif tag in _RAW:
                at = skip_until = len(page)
            else:
                endless.add(tag)
            continue
        if ending:
            k = held.last(tag)
            if k >= 0:
                held.close(k)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        # a block ends an open paragraph, and list items and cells end each other
        if held.solid and held.stack[held.solid[-1]][0] == "p":
            held.close(held.solid[-1])
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            k = held.last(*ends)
            if k > held.last(*within):
                held.close(k)
        held.push(tag, _names(attributes))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """The vectors of all blocks of some pages, one page after the other."""
    flat = [b for p in pages for b in p]
    n, t = len(flat), len(PATH_TAGS)
    x = np.zeros((n, FEATURES), dtype=np.float32)
    if not n:
        return x
    for i, b in enumerate(flat):
        row = x[i]
        for k in b.tags:
            row[k] = 1
        if b.inner is not None:
            row[t + b.inner] = 1
        for k in b.names:
            row[2 * t + k] = 1
    w = bytewords.words(pa.array([b.text for b in flat], pa.string()))
    count = np.diff(w.first)
    at = w.text_of() * WORDS + (w.hash >> np.uint64(40)).astype(np.int64) % WORDS
    base = 2 * t + NAMES
    x[:, base : base + WORDS] = np.sqrt(np.bincount(at, minlength=n * WORDS).reshape(n, WORDS) / np.maximum(1, count)[:, None])
    m = x[:, base + WORDS :]
    size = np.array([len(b.text) for b in flat], dtype=np.float64)
    links = np.array([b.linked for b in flat], dtype=np.float64) / np.maximum(1, size)
    text = [b.text for b in flat]
    m[:, 0], m[:, 1], m[:, 2] = np.log1p(size) / 6, np.log1p(count) / 5, links
    m[:, 3] = np.array([s[-1] in ".!?:;…»”\"" for s in text])
    m[:, 4] = np.array([s.count(",") + s.count(".") for s in text]) / np.maximum(1, count)
    m[:, 5] = np.array(["©" in s or "·" in s or "|" in s for s in text])
    m[:, 6] = np.array([sum(c.isupper() for c in s) for s in text]) / np.maximum(1, size)
    m[:, 7] = count <= 3
    m[:, 8] = np.array([b.depth for b in flat]) / 10
    lengths = np.array([len(p) for p in pages])
    place = np.concatenate([np.arange(k) for k in lengths]) if len(lengths) else np.zeros(0)
    of = np.repeat(lengths, lengths)
    m[:, 9], m[:, 10] = place / np.maximum(1, of), (of - 1 - place) / np.maximum(1, of)
    m[:, 11] = np.log1p(place) / 5
    total = np.add.reduceat(size, (np.cumsum(lengths) - lengths)[lengths > 0])
    m[:, 12] = size / np.repeat(total, lengths[lengths > 0])
    m[:, 13] = 1
    return x
