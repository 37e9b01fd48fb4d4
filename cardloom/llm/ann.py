"""Approximate nearest neighbours: inverted lists of product-quantised residuals, and exact reranking.

Fitting: on a sample of at most ``SAMPLE`` vectors, k-means gives the coarse centroids, and
k-means in each subspace of the residuals the codebooks. Two figures are calibrated there on the
true neighbours of sampled queries: how many lists hold ``target`` of them (a query visits so many,
and further ones until they hold more than k entries), and by how much their rough scores, in parts
of the largest error that their codes allow, fell short of the exact ones, all but half of what
``target`` leaves out (with a target of 1 the largest error itself).

Indexing: every vector goes to the list of its nearest centroid, with the codes of its residual.
Equal vectors are one entry, which keeps the ``k + 1`` smallest of their ids: no answer of k
needs more of them. Searching: each query visits the lists whose centroids have the largest
inner products with it. Lists and their queries are dealt in blocks of bounded size; in a block
asymmetric distance tables rank the codes, and the best ``RERANK`` are measured exactly, on the
original vectors in double precision. Their k + 1 best bound the rest: every entry whose rough
score, with the calibrated part of its code's largest error, reaches them is measured too. That
part grows by what the codes of a block were typically off for the query, up to the whole, so that
vectors unlike those of the sample are measured more often, not lost.

Defined results: vectors that are null, empty, zero, not of the commonest length, or that hold
null or non-finite components take no part; ties go to the smaller id; rows with a query's id
are its own and no candidates; rows that repeat a vector under other ids are candidates each;
fewer candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import bounded_batches, groups, written

SAMPLE = 32_768
LIST_ROWS = 2048
LISTS = 4096
SUBSPACES = 16
TARGET = 0.98
RERANK = 96
BLOCK = 8192
#: Exact scores computed at a time; rows that a task gathers from its blocks before it reports them.
PAIRS, HELD = 65_536, 262_144


@dataclass
class Index:
    centroids: np.ndarray  # list, dimension
    books: list[np.ndarray]  # of each subspace: code, dimension
    cuts: np.ndarray  # bounds of the subspaces
    probes: int
    spread: float  # the part of a code's largest error that a rough score is given


def _kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c**2).sum(1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = np.argmax(x[lo : lo + 4096] @ c.T - half, axis=1)
    return out


def train(x: np.ndarray, lists: int, k: int, *, target: float = TARGET, seed: int = 3) -> Index:
    """Centroids, codebooks and the number of lists to visit, from a sample of vectors."""
    r = np.random.default_rng(seed)
    c = _kmeans(x, max(1, min(lists, len(x) // 4 or 1)), 10, r)
    near = _nearest(x, c)
    residual = x - c[near]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    part = residual[r.permutation(len(x))[: SAMPLE // 2]]
    books = [_kmeans(part[:, a:b], 256, 6, r) for a, b in zip(cuts, cuts[1:], strict=False)]
    q = r.permutation(len(x))[:256]
    inner = x[q] @ x.T
    inner[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-inner, axis=1)[:, : min(k, len(x) - 1)]
    of = np.arange(len(q))[:, None]
    place = np.argsort(np.argsort(-(x[q] @ c.T), axis=1), axis=1)
    needed = place[of, near[best]].ravel()
    probes = int(np.quantile(needed, target)) + 1 if len(needed) else 1
    index = Index(c, books, cuts, min(len(c), probes), 1.0)
    if target < 1 and best.size:
        held = np.unique(best)
        rough = decoded(*encode(x[held], index), index)
        left_out = np.zeros(len(x))
        left_out[held] = np.linalg.norm(x[held] - rough, axis=1)
        whole = np.zeros_like(x)
        whole[held] = rough
        short = inner[of, best] - np.einsum("qd,qkd->qk", x[q], whole[best])
        most = np.maximum(np.linalg.norm(x[q], axis=1)[:, None] * left_out[best], np.finfo(np.float64).tiny)
        index.spread = float(np.clip(np.quantile(short / most, (1 + target) / 2), 0, 1))
    return index


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(list, codes) of each vector."""
    near = _nearest(x, index.centroids)
    residual = x - index.centroids[near]
    codes = [_nearest(residual[:, a:b], book) for a, b, book in zip(index.cuts, index.cuts[1:], index.books, strict=False)]
    return near, np.stack(codes, axis=1).astype(np.uint8)


def decoded(near: np.ndarray, codes: np.ndarray, index: Index) -> np.ndarray:
    """The vectors that lists and codes stand for."""
    return index.centroids[near] + np.concatenate([book[codes[:, m]] for m, book in enumerate(index.books)], axis=1)


def scan(index: Index, number: int, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, keep: int, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, exact score) of the best ``keep`` entries of a block for each query."""
    # of each code, one row: the scores of all queries
    tables = [(book @ queries[:, a:b].T).astype(np.float32) for a, b, book in zip(index.cuts, index.cuts[1:], index.books, strict=False)]
    rows, found, scores = [], [], []
    center = index.centroids[number]
    base = (queries @ center).astype(np.float32)
    keep = min(keep, len(ids))
    most = min(max(rerank, 2 * keep), len(ids))
    # a rough score is off by at most the length of a query times that of what the codes leave out, and by rounding
    left_out = np.linalg.norm(vectors - decoded(np.full(len(ids), number), codes, index), axis=1)
    left_out = (left_out + 4e-6 * (np.linalg.norm(center) + sum(np.linalg.norm(book, axis=1).max() for book in index.books))).astype(np.float32)
    lengths, longest = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1).max()
    slack = 8 * vectors.shape[1] * np.finfo(np.float64).eps * lengths * longest
    for lo in range(0, len(queries), 256):
        p = slice(lo, lo + 256)
        by_entry = np.repeat(base[None, p], len(ids), axis=0)
        for m, table in enumerate(tables):
            by_entry += table[:, p][codes[:, m]]
        rough = np.ascontiguousarray(by_entry.T)
        some = np.argpartition(-rough, most - 1, axis=1)[:, :most]
        exact = np.einsum("qd,qcd->qc", queries[p], vectors[some])
        least = np.partition(exact, most - keep, axis=1)[:, most - keep]
        with np.errstate(all="ignore"):  # what single precision can't hold is measured
            off = (exact - np.take_along_axis(rough, some, axis=1)) / (lengths[p, None] * left_out[some])
            part = np.clip(index.spread + np.maximum(np.median(off, axis=1), 0), 0, 1)
            near = ~(rough + (lengths[p] * part)[:, None].astype(np.float32) * left_out < (least - slack[p])[:, None])
        np.put_along_axis(near, some, exact >= (least - slack[p])[:, None], axis=1)
        of, at = np.nonzero(near)
        exact = np.concatenate([np.einsum("pd,pd->p", queries[p][of[i : i + PAIRS]], vectors[at[i : i + PAIRS]]) for i in range(0, len(of), PAIRS)])
        order = np.lexsort((ids[at], -exact, of))
        starts = np.searchsorted(of, np.arange(len(near)))
        order = order[np.arange(len(of)) - starts[of] < keep]
        rows.append(lo + of[order])
        found.append(ids[at[order]])
        scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k largest inner products with each query row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors, id_col, vector_col)
    size = rows.agg(F.count("*")).first()[0]
    if not size:
        return spark.createDataFrame([], schema)
    # equal vectors: the k + 1 smallest ids are ranked before the shuffle already
    by_id = Window.partitionBy("v").orderBy("vec_id")
    members = rows.select(F.transform("v", lambda x: x + 0.0).alias("v"), "vec_id").distinct()
    members = members.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v")))
    members = written(members.withColumn("entry", F.xxhash64("v")), "members")
    entries = members.where("place = 1")
    part = entries.orderBy(F.xxhash64("vec_id"), "entry").limit(sample).select("v").toPandas()
    index = train(np.stack(part["v"].to_numpy()).astype(np.float64), max(8, min(LISTS, size // LIST_ROWS)), k, target=target)
    held = spark.sparkContext.broadcast(index)
    cells = written(entries.select("rep", "entry", "v").mapInArrow(_listed(held), "list int, rep bigint, entry bigint, vec binary, code binary"), "cells")
    asked = usable(queries, id_col, vector_col).where(F.size("v") == index.centroids.shape[1]).select("vec_id", F.xxhash64("v").alias("entry"), "v").distinct()
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for number, n in cells.groupBy("list").count().collect():
        sizes[number] = n
    visits = written(asked.mapInArrow(_visited(held, sizes, k), "list int, rep bigint, entry bigint, vec binary"), "visits")
    # at most LISTS rows each
    blocks = cells.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chunks = visits.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    plan = F.broadcast(blocks.join(chunks, "list"))
    left = cells.join(plan, "list").select("list", F.pmod(F.xxhash64("entry", "rep"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "rep", "entry", "vec", "code")
    right = visits.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", "entry"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "rep", "entry", "vec", F.lit(None).cast("binary").alias("code"))
    both = left.unionAll(right).repartition("list", "block", "chunk").sortWithinPartitions("list", "block", "chunk", "side")
    near = both.mapInArrow(_scanned(held, k + 1), "query_id bigint, query_entry bigint, entry bigint, rep bigint, score double")
    query = ["query_id", "query_entry"]
    best = Window.partitionBy(*query).orderBy(F.desc("score"), "rep", "entry")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    full = near.join(members.select("entry", "rep", "vec_id"), ["entry", "rep"]).where("vec_id <> query_id").select(*query, "vec_id", "score").distinct()
    last = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                near, codes = encode(x, held.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), b.column("rep"), b.column("entry"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["list", "rep", "entry", "vec", "code"],
                )

    return run


def _visited(held, sizes: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                x = _matrix(b.column("v"))
                inner = x @ index.centroids.T
                order = np.argsort(-inner, axis=1)
                # one entry may be the query itself
                short = (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1
                visited = np.arange(order.shape[1]) < np.maximum(short, index.probes)[:, None]
                lists, of = order[visited], pa.array(np.nonzero(visited)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), b.column("vec_id").take(of), b.column("entry").take(of), pa.array([r.tobytes() for r in x], pa.binary()).take(of)], names=["list", "rep", "entry", "vec"]
                )

    return run


def _best(rows: np.ndarray, keep: int) -> np.ndarray:
    """The best ``keep`` rows of each query."""
    rows = rows[np.lexsort((rows["entry"], rows["rep"], -rows["score"], rows["query_entry"], rows["query_id"]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows["query_id"][1:] != rows["query_id"][:-1]) | (rows["query_entry"][1:] != rows["query_entry"][:-1])
    starts = np.flatnonzero(first)
    return rows[np.arange(len(rows)) - starts[np.cumsum(first) - 1] < keep]


def _scanned(held, keep: int):
    """Scans of blocks; what several blocks of a task have for a query is merged before it leaves."""
    names = ["query_id", "query_entry", "entry", "rep", "score"]
    kinds = [(n, "f8" if n == "score" else "i8") for n in names]

    def batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = np.zeros(0, dtype=kinds)
        for g in groups(batches, ["list", "block", "chunk"]):
            g = g.sort_by([("side", "ascending"), ("rep", "ascending"), ("entry", "ascending")])
            side = g["side"].to_numpy()
            n = int((side == 0).sum())
            if n in (0, len(side)):
                continue
            x = np.stack([np.frombuffer(v, dtype=np.float64) for v in g["vec"].to_pylist()])
            codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in g["code"].slice(0, n).to_pylist()])
            rep, entry = g["rep"].to_numpy(), g["entry"].to_numpy()
            q, at, score = scan(held.value, g["list"][0].as_py(), x[n:], np.arange(n), x[:n], codes, keep)
            rows = np.empty(len(q), dtype=kinds)
            for name, values in zip(names, (rep[n:][q], entry[n:][q], entry[at], rep[at], score), strict=True):
                rows[name] = values
            gathered = np.concatenate([gathered, rows])
            if len(gathered) > HELD:
                gathered = _best(gathered, keep)
                if len(gathered) > HELD // 2:  # other queries: little to merge
                    yield batch(gathered)
                    gathered = gathered[:0]
        if len(gathered):
            yield batch(_best(gathered, keep))

    return run
