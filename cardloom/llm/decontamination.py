"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of the benchmark items. For each pattern length
a shift table tells how far a search may jump when it sees a given block of words at the end of
its window; where the shift is zero, the hash of that block (the suffix) picks a bucket of
patterns, a hash of their first block (the prefix) thins it, and the remaining patterns are
compared word by word and byte by byte.

Defined results: a null or wordless text has no hits; a wordless item has no window; items of
one id count once; an item without id marks words but isn't listed; ids of items may be of any
type that sorts, and are listed in it; rows that repeat are each reported. Columns other than the
two named are ignored, and those two may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import bytewords
from cardloom.llm.common import bounded_batches, quoted, slices, written

WINDOW = 10
#: Windows in one search table; a benchmark with more is searched in several passes.
TABLE_WINDOWS = 200_000
_BITS = 18
_LANE = 256
_PAIRS = 1 << 18
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass
class Patterns:
    """The search tables for all patterns of one length."""

    length: int
    block: int
    shift: np.ndarray  # by the top bits of a block's hash
    suffix: np.ndarray  # sorted distinct hashes of the patterns' last blocks
    bucket: np.ndarray  # index into the patterns of each bucket's first; one more at the end
    prefix: np.ndarray  # hash of each pattern's first block
    words: np.ndarray  # hash of each word of each pattern
    text: list[bytes]
    items: list[list[int]]


def _blocks(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each position."""
    out = h[at] * bytewords.PLACES[0]
    for k in range(1, size):
        out += h[at - k] * bytewords.PLACES[k]
    return bytewords.mix(out)


def search_tables(rows: list[tuple[Hashable | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    """The tables for the windows of (item_id, text) rows."""
    w = bytewords.words(pa.array([t for _, t in rows], pa.string()))
    found: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for r, (item, _) in enumerate(rows):
        lo, hi = int(w.first[r]), int(w.first[r + 1])
        n = min(window, hi - lo)
        for i in range(lo, hi - n + 1) if n else ():
            held = found.setdefault(n, {}).setdefault(w.bytes_at(i, n), (i, set()))
            if item is not None:
                held[1].add(item)
    return [_patterns(w.hash, n, by_text) for n, by_text in sorted(found.items())]


def _patterns(h: np.ndarray, n: int, by_text: dict[bytes, tuple[int, set[int]]]) -> Patterns:
    size = min(2, n)
    text = list(by_text)
    begin = np.array([by_text[t][0] for t in text])
    shift = np.full(1 << _BITS, n - size + 1, dtype=np.int64)
    for end in range(size - 1, n):
        key = _blocks(h, begin + end, size) >> np.uint64(64 - _BITS)
        np.minimum.at(shift, key.astype(np.int64), n - 1 - end)
    last = _blocks(h, begin + n - 1, size)
    order = np.argsort(last, kind="stable")
    suffix, first = np.unique(last[order], return_index=True)
    begin = begin[order]
    return Patterns(
        n, size, shift, suffix, np.append(first, len(text)), _blocks(h, begin + size - 1, size),
        h[begin[:, None] + np.arange(n)], [text[k] for k in order], [sorted(by_text[text[k]][1]) for k in order],
    )


def search(w: bytewords.Words, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, pattern) of every occurrence of the patterns."""
    lo, hi = w.first[:-1] + p.length - 1, w.first[1:]
    lanes = np.maximum(0, -(-(hi - lo) // _LANE))
    number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.repeat(lo, lanes) + number * _LANE
    stop = np.minimum(at + _LANE, np.repeat(hi, lanes))
    hits, codes = [], []
    while len(at):
        code = _blocks(w.hash, at, p.block)
        jump = p.shift[(code >> np.uint64(64 - _BITS)).astype(np.int64)]
        zero = jump == 0
        hits.append(at[zero])
        codes.append(code[zero])
        at = at + np.maximum(jump, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, code = np.concatenate(hits), np.concatenate(codes)
    k = np.minimum(np.searchsorted(p.suffix, code), len(p.suffix) - 1)
    known = p.suffix[k] == code
    at, k = at[known] - p.length + 1, k[known]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(p.bucket[k + 1] - p.bucket[k])
    lo = 0
    while lo < len(at):  # a bounded number of (place, pattern) pairs at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PAIRS, side="right")))
        found.append(_confirmed(w, p, at[lo:hi], k[lo:hi]))
        lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _confirmed(w: bytewords.Words, p: Patterns, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and patterns of buckets that pass the prefix, the words and the bytes."""
    size = p.bucket[k + 1] - p.bucket[k]
    which = np.repeat(p.bucket[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at = np.repeat(at, size)
    kept = _blocks(w.hash, at + p.block - 1, p.block) == p.prefix[which]
    at, which = at[kept], which[kept]
    kept = np.ones(len(at), dtype=bool)
    for j in range(p.length):
        kept &= w.hash[at + j] == p.words[which, j]
    at, which = at[kept], which[kept]
    same = np.fromiter((w.bytes_at(i, p.length) == p.text[x] for i, x in zip(at.tolist(), which.tolist(), strict=True)), bool, len(at))
    return at[same], which[same]


def _marked(w: bytewords.Words, tables: list[Patterns]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each text the spans of hit words, counted from its first word, and the items found."""
    n = len(w.first) - 1
    step = np.zeros(len(w.hash) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in range(n)]
    for p in tables:
        at, which = search(w, p)
        np.add.at(step, at, 1)
        np.add.at(step, at + p.length, -1)
        for t, x in zip((np.searchsorted(w.first, at, side="right") - 1).tolist(), which.tolist(), strict=True):
            items[t].update(p.items[x])
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    hit = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
    edge = hit[1:] != hit[:-1]
    edge[w.first[:-1]] |= hit[1:][w.first[:-1]] if len(w.hash) else False
    begins = np.flatnonzero(edge & hit[1:])
    if len(begins):
        t = np.searchsorted(w.first, begins, side="right") - 1
        stops = np.flatnonzero(hit[:-1] & ~hit[1:])
        end = np.minimum(stops[np.searchsorted(stops, begins, side="right")], w.first[t + 1])
        for k, b, e in zip(t.tolist(), begins.tolist(), end.tolist(), strict=True):
            spans[k].append((b - int(w.first[k]), e - int(w.first[k])))
    return spans, [sorted(x) for x in items]


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two sets of spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, table_windows: int = TABLE_WINDOWS,
) -> DataFrame:
    """``docs`` (id and text) with ``n_words``, ``spans`` (hit words, end exclusive) and ``items``.

    The tables of at most about ``table_windows`` windows go to every task; a larger benchmark
    is cut into groups of items, and long items into parts that overlap, and the texts pass through
    one search after the other, without a shuffle. Between two searches they are written to the
    shared folder, so that no task ever holds the tables of more than one.
    """
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).selectExpr(
        "doc_id", "text", "0L AS n_words", f"CAST(array() AS {SPANS}) AS spans", f"CAST(array() AS array<{kind}>) AS items"
    )
    return _passed(out, _tables(benchmark, item_col, item_text_col, window, table_windows), _searcher)


def filter_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, table_windows: int = TABLE_WINDOWS,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no window occurs; searches follow each other as in ``find_benchmark``."""
    # Arrow stages don't take names with dots
    rows, text = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), f"c{docs.columns.index(text_col)}"
    return _passed(rows, _tables(benchmark, item_col, item_text_col, window, table_windows), lambda tables: _filter(tables, text)).toDF(*docs.columns)


def _passed(rows: DataFrame, tables: Iterator[Broadcast], search: Callable[[Broadcast], Callable]) -> DataFrame:
    """``rows`` after one search for each of the tables; all but the last are written, and their tables given up, before the next ones are made."""
    before: Broadcast | None = None
    for now in tables:
        if before is not None:
            rows = written(rows, "searched")
            before.unpersist()
        rows, before = rows.mapInArrow(search(now), rows.schema), now
    return rows


def _filter(tables, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                spans, _ = _marked(bytewords.words(batch.column(text_col)), tables.value)
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))

    return run


def _tables(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, table_windows: int) -> Iterator[Broadcast]:
    """Broadcast search tables of one group of items after the other."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    low = F.translate(F.col(quoted(item_text_col)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(quoted(item_col)).alias("item"), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    # parts of an item overlap so that each of its windows lies in one
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(table_windows))
    items = items.select("item", F.transform(starts, lambda at: F.slice("words", at + 1, F.lit(table_windows + window - 1))).alias("parts")).select("item", F.explode("parts").alias("words"))
    total = items.agg(F.sum(F.greatest(F.lit(1), F.size("words") - (window - 1)))).first()[0] or 0
    groups = max(1, -(-int(total) // table_windows))
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == g)
        yield spark.sparkContext.broadcast(search_tables([(r.item, " ".join(r.words)) for r in part.toLocalIterator()], window))


def _searcher(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = bytewords.words(batch.column("text"))
                spans, items = _marked(w, tables.value)
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                spans = [_joined([(x["start"], x["end"]) for x in a], b) if a else b for a, b in zip(old_spans, spans, strict=True)]
                items = [sorted({*a, *b}) if a else b for a, b in zip(old_items, items, strict=True)]
                span = batch.schema.field("spans").type
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(np.diff(w.first)), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span), pa.array(items, batch.schema.field("items").type)],
                    schema=batch.schema,
                )

    return run


def report(found: DataFrame) -> DataFrame:
    """The digest of ``find_benchmark``: counts, the items as one hash, and the verdict."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
