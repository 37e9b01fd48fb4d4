"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word shingles. Texts with equal sets collapse into one node, so copies are
never paired. MinHash bands propose candidates: nodes that share a bucket. Inside a bucket the
MinHash values of two nodes are compared a few at a time, and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold (uniform prior, binomial
matches) falls below a tolerance. Of the pairs that remain a spanning forest is kept; its trees
are neighbourhoods, which hold all pairs that may be links, and no two nodes but by a chain of
likely ones. The pairs of a neighbourhood go through the same pruning, and those left are
verified exactly on the sets themselves. MinHash values are compared by one byte each: values
that differ agree once in 256 times, which lets a pair stay but never drops one.

A bucket or neighbourhood of more than ``BLOCK`` nodes is cut into blocks, and each pair of
blocks is a task of its own that returns link counts and a forest, never the pairs: the rows that
are moved grow with size * size / BLOCK, and none of the links is lost.

With 25 bands of 5 values a pair at similarity 0.8 exactly is proposed with probability
0.99995, at 0.85 with more than 0.999999. Shingles are compared as 64-bit hashes.

Defined results: a null or wordless text is alone in its class; a text of fewer words than a
shingle is one shingle; rows that repeat are copies; ids that repeat with other texts keep a
row for each; rows without an id have links like others, and a class of none but such rows has
a null class id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import bytewords
from cardloom.llm.common import BROADCAST_ROWS, bounded_batches, slices, unused, whole_groups, written
from cardloom.llm.graphs import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 25, 5
VALUES = BANDS * ROWS
STEP = 25
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
BITMAP_BITS = 1 << 28
#: Pairs compared at a time.
PAIRS = 1 << 18

_random = np.random.default_rng(20240607)
_FACTOR = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_MASK = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal MinHash values with which the threshold is still likely enough.

    With a uniform prior the similarity after m matches is Beta(m + 1, n - m + 1), and it exceeds
    t with the probability that a binomial of n + 1 trials of chance t gives at most m.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty sets that begin at ``at`` (one more at the end)."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, VALUES), dtype=np.uint32)
    v = np.empty_like(x)
    for k in range(VALUES):
        np.bitwise_xor(x, _MASK[k], out=v)
        np.multiply(v, _FACTOR[k], out=v)
        out[:, k] = np.minimum.reduceat(v, at[:-1])
    return out


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(sorted distinct shingles, node) of each text, and all shingles' positions; node 0: none."""
    h, at = bytewords.shingles(bytewords.words(batch.column("text")), shingle)
    sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
    node = np.array([_node(s) for s in sets], dtype=np.int64)
    return sets, node, at


def _node(s: np.ndarray) -> int:
    """A number for a set: 63 bits of a hash of its sum, its size and its least element."""
    if not len(s):
        return 0
    parts = np.array([s.sum(dtype=np.uint64), bytewords.mix(s).sum(dtype=np.uint64), s[0]], dtype=np.uint64) * bytewords.PLACES[:3]
    h = int(bytewords.mix(np.array([int(parts.sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], dtype=np.uint64))[0])
    return (h >> 1) or 1


def band_keys(values: np.ndarray) -> np.ndarray:
    """The bucket of each set in each band."""
    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64) * bytewords.PLACES[:ROWS]
    return bytewords.mix(v.sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * bytewords.PLACES[ROWS]).view(np.int64)


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets, node, _ = _sets(batch, shingle)
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                sketch: list[bytes | None] = [None] * batch.num_rows
                keys: list[np.ndarray | None] = [None] * batch.num_rows
                if len(some):
                    at = np.concatenate(([0], np.cumsum(size[some])))
                    rows = signatures(np.concatenate([sets[i] for i in some]), at)
                    for i, k, r in zip(some.tolist(), band_keys(rows), (rows >> np.uint32(24)).astype(np.uint8), strict=True):
                        keys[i], sketch[i] = k, r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("mark"), batch.column("pick"), pa.array(node), pa.array(size), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc_id", "mark", "pick", "node", "n", "keys", "sketch"],
                )

    return run


def _shingled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets, node, _ = _sets(batch, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's: the least node of its tree) after the trees of ``a`` and ``b`` are joined, pair by pair."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while not np.array_equal(higher := label[label], label):
            label = higher


def _likely(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not ruled out, by their sizes or by their MinHash values."""
    near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[near], b[near]
    equal = np.zeros(len(a), dtype=np.int64)
    for k in range(0, VALUES, STEP):
        for i in range(0, len(a), 1 << 16):  # pairs at a time
            p = slice(i, i + (1 << 16))
            equal[p] += (sketch[a[p], k : k + STEP] == sketch[b[p], k : k + STEP]).sum(1)
        likely = equal >= least_matches(k + STEP, threshold, tolerance)
        a, b, equal = a[likely], b[likely], equal[likely]
    return a, b


def _pairs(start: np.ndarray, end: np.ndarray, side: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each group; of a crossed group, those of different sides. A bounded number at a time, or one group's."""
    size = end - start
    for n in np.unique(size[size > 1]).tolist():
        u, v = np.triu_indices(n, 1)
        of = np.flatnonzero(size == n)
        step = max(1, PAIRS // len(u))
        for lo in range(0, len(of), step):
            some = of[lo : lo + step]
            a, b = ((start[some, None] + x).ravel() for x in (u, v))
            kept = ~np.repeat(crossed[some], len(u)) | (side[a] != side[b])
            yield a[kept], b[kept]


def linked(sets: list[np.ndarray], sketch: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The verified pairs of one task: between sides 0 and 1, or all pairs if there is one side."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if side.min() == side.max():
        a, b = np.triu_indices(len(sets), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    a, b = _likely(sketch, size, a, b, threshold, tolerance)
    common = _common(sets, a, b)
    kept = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[kept], b[kept]


def _neighbours(threshold: float, tolerance: float):
    """Forests of the likely pairs of buckets: (node, least node of its tree)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"]):
            key = np.stack([table[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            start = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1))
            node, size, side = table["node"].to_numpy(), table["n"].to_numpy(), table["block"].to_numpy()
            sketch = np.stack([np.frombuffer(x, dtype=np.uint8) for x in table["sketch"].to_pylist()])
            label = np.arange(len(node))
            for a, b in _pairs(start, np.append(start[1:], len(key)), side, key[start, 1] != key[start, 2]):
                label = merged(label, *_likely(sketch, size, a, b, threshold, tolerance))
            child = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[label[child]])], names=["a", "b"])

    return run


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    rank = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, 2048):  # columns at a time
        p = slice(*np.searchsorted(rank, (lo, lo + 2048)))
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[owner[p], rank[p] - lo] = 1
        total += m @ m.T
    return total[a, b].astype(np.int64)


def _verified(threshold: float, tolerance: float):
    """Link counts of the nodes of pairs of blocks, and forests of their links (links 0)."""
    def group(rows: pa.Table) -> tuple[list, list, list]:
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"].to_pylist()]
        sketch = np.stack([np.frombuffer(x, dtype=np.uint8) for x in rows["sketch"].to_pylist()])
        block = rows["block"].to_numpy()
        side = (block != block.min()).astype(np.int64)
        if rows["i"][0].as_py() != rows["j"][0].as_py() and side.max() == 0:
            return [], [], []  # the other block is empty
        a, b = linked(sets, sketch, side, threshold, tolerance)
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        label = merged(np.arange(len(node)), a, b)
        child, some = np.flatnonzero(label != np.arange(len(node))), np.flatnonzero(links)
        return (
            node[child].tolist() + node[some].tolist(), node[label[child]].tolist() + [None] * len(some), [0] * len(child) + links[some].astype(np.int64).tolist()
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "i", "j"]):
            key = np.stack([table[c].to_numpy() for c in ("component", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            found: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    for whole, part in zip(found, group(table.slice(lo, hi - lo)), strict=True):
                        whole.extend(part)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["node", "other", "links"])

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK,
) -> DataFrame:
    """For every row: ``doc_id``, ``class_id`` (least id of the texts it is linked with, directly or
    through others), ``n_links`` (rows at least as similar as the threshold), ``node`` (its set; 0: none),
    ``component`` (a node of its class), ``mark`` (a hash of its text).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = texts.withColumn("mark", F.xxhash64("text")).withColumn("pick", F.xxhash64("doc_id", "mark"))
    signed = written(marked.mapInArrow(_signed(shingle), f"doc_id {kind}, mark bigint, pick bigint, node bigint, n bigint, keys array<bigint>, sketch binary"), "signed")
    sets = signed.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("pick").alias("pick"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    sets = written(sets, "sets")
    place = components(_ties(sets, threshold, tolerance, block))
    edges = written(_links(marked, sets, place, shingle, threshold, tolerance, block), "links")
    joined = components(edges.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = edges.groupBy("node").agg(F.sum("links").alias("links"))
    found = sets.select("node", "rep", "copies").join(links, "node", "left").join(joined, "node", "left")
    found = found.withColumn("component", F.coalesce("component", "node"))
    classes = found.groupBy("component").agg(F.min("rep").alias("class_id"))
    found = written(found.join(classes, "component").select("node", "component", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    return signed.select("doc_id", "node", "mark").join(found, "node", "left").select(
        "doc_id", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "node", "component", "mark"
    )


def _blocked(rows: DataFrame, blocks: DataFrame, group: str, keep: list[str]) -> DataFrame:
    """Each row once for every pair (``i``, ``j``) of its group's blocks that its own belongs to, dealt by pair.

    ``blocks``: the groups of several blocks. Each has more than ``BLOCK`` rows, so that they are few.
    """
    blocks = written(blocks, "blocks")
    rows = rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(group, "block", *keep, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *keep)
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def _ties(sets: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Forests (a, b) of the likely pairs of all buckets."""
    posted = sets.select("node", F.explode("keys").alias("key"))
    buckets = written(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    # an inner join: a semi-join would be moved in front of the filter
    shared = _probably(posted, "key", buckets.select("key"), buckets.count()).join(buckets.select("key"), "key")
    shared = shared.join(sets.select("node", "n", "sketch"), "node")
    blocks = buckets.select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")).where("blocks > 1")
    return _blocked(shared, blocks, "key", ["node", "n", "sketch"]).mapInArrow(_neighbours(threshold, tolerance), "a bigint, b bigint")


def _links(texts: DataFrame, sets: DataFrame, place: DataFrame, shingle: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Link counts of nodes, and edges of spanning forests, of every pair of blocks."""
    members = written(place.join(sets.select("node", "pick", "copies", "n", "sketch"), "node"), "members")
    blocks = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    full = _probably(texts, "pick", members.select("pick"), members.count()).select("text").mapInArrow(_shingled(shingle), "node bigint, shingles binary")
    rows = members.select("component", "node", "copies", "sketch").join(full.dropDuplicates(["node"]), "node")
    return _blocked(rows, blocks, "component", ["node", "copies", "sketch", "shingles"]).mapInArrow(_verified(threshold, tolerance), "node bigint, other bigint, links bigint")


def _probably(df: DataFrame, key: str, chosen: DataFrame, number: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the ``number`` chosen ones, and perhaps a few more, without moving them.

    A bitmap of hashes, of at most ``BITMAP_BITS`` bits whatever the input, goes to every
    task in rows of 4 KB. For so many that it would pass most rows, a semi-join is used.
    """
    if number > BITMAP_BITS // 4:
        return df.join(chosen.distinct(), key, "left_semi")
    bits = 1 << 20
    while bits < min(16 * number, BITMAP_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    rows = chosen.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    held = df.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(rows), "bucket")
    octet = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(place) div 8 as int) + 1, 1)), 16, 10) as int)")
    return held.withColumn("octet", octet).where("getbit(octet, cast(bitmap_bit_position(place) % 8 as int)) = 1").select(*df.columns)


#: A character of a word.
_WORD_CHARACTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def one_of_each(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, of the least id, and all rows without words.

    ``docs`` may have columns of any names. The rows that go are told by their ids and the hashes
    of their texts; up to ``BROADCAST_ROWS`` of these are sent to every task, so that no text is
    moved; for more, the rows are joined.
    """
    rows = found.where("node <> 0").groupBy("component", "class_id", "doc_id", "mark").agg(F.count("*").alias("rows"))
    rows = written(rows, "rows-of-classes")
    least = F.struct((~F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("other"), "mark", "doc_id")
    first = rows.groupBy("component").agg(F.min(least).alias("x")).select("component", "x.mark", "x.doc_id", F.lit(True).alias("first"))
    # joined by all of a row's keys: no class is a hot one
    same_row = (rows["component"] == first["component"]) & (rows["mark"] == first["mark"]) & rows["doc_id"].eqNullSafe(first["doc_id"])
    first = rows.join(first, same_row, "left").select(rows["doc_id"], rows["mark"], rows["rows"], F.coalesce("first", F.lit(False)).alias("stays"))
    own, mark = unused(docs, "id"), unused(docs, "mark")
    text = F.col(text_col)
    wordless = ~F.coalesce(text.rlike(_WORD_CHARACTER), F.lit(False))
    keys = first.groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(F.max("stays").alias("stays"), F.max("rows").alias("rows"))
    keys = written(keys, "decisions")
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(mark)) & ~wordless

    def few(part: DataFrame) -> DataFrame:
        part = part.select(own, mark)
        return F.broadcast(part) if part.count() <= BROADCAST_ROWS else part

    kept = docs.join(few(keys.where("NOT stays")), same, "left_anti")
    repeated = keys.where("stays AND rows > 1")
    if repeated.isEmpty():
        return kept
    repeated = few(repeated)
    return kept.join(repeated, same, "left_anti").unionAll(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
