"""Token-id files: raw ids in shards by document key, each with a minimal perfect hash index.

A shard holds, one after the other: a magic word, the ids of its documents (unsigned 16-bit
where the vocabulary allows, else 32-bit, little-endian), a record of key, start and number of
ids for each document, the first record of each indexed key, the bits and fingerprints of the
index, and a JSON footer with its length and the magic word. Shards follow each other in
ascending key order; the manifest, a Parquet table, has their first and last keys and the
number of ids before each.

A task writes its range of keys and begins another shard once ``shard_bytes`` of text are in the
present one, so that memory holds one shard, or one document. ``read_tokens`` reads all
documents; ``lookup`` reads those of some keys: their shards are found by the manifest's keys,
and of a shard only its index and the ids asked for are read.

Defined results: null and empty texts are their end id alone; rows that repeat a key follow
each other, by a hash of their text, perhaps into the next shard, and a look-up gives the first;
a null key comes first and has a record but no index entry. Keys are integers. Other columns
are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.common import bounded_batches, groups, make_folder, new_folder, open_file, put_file, slices
from cardloom.llm.perfect_hash import PerfectHash
from cardloom.llm.tokens import encoder

MAGIC = b"CLTOKEN1"
#: Bytes of text of a shard.
#: Most rows of a task on average, however short their texts are.
TASK_ROWS = 1 << 18
SHARD_BYTES = 32 << 20
#: Most tasks that read; each then has several shards.
MOST_TASKS = 20_000
_MANIFEST = "shard bigint, file string, first bigint, last bigint, docs bigint, ids bigint, before bigint"
_RECORD = np.dtype([("key", "<i8"), ("start", "<u8"), ("n", "<u4"), ("null", "<u4")])


def shard_parts(ids: list[np.ndarray], keys: np.ndarray, nulls: np.ndarray, counts: np.ndarray, width: int) -> Iterator[bytes]:
    """The bytes of a shard; its documents are in the order of their keys."""
    yield MAGIC
    total = 0
    for part in ids:
        total += len(part)
        yield part.astype(f"<u{width}").tobytes()
    records = np.zeros(len(keys), dtype=_RECORD)
    records["key"], records["null"], records["n"] = keys, nulls, counts
    records["start"] = np.cumsum(counts) - counts
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])) & ~nulls) if len(keys) else np.zeros(0, np.int64)
    index = PerfectHash.of(keys[first])
    slots = np.zeros(len(first), dtype="<u4")
    slots[index.number(keys[first])] = first
    about, bits = index.parts()
    sections = [records.tobytes(), slots.tobytes(), *bits]
    yield from sections
    footer = json.dumps({"width": width, "ids": total, "sections": [len(s) for s in sections], **about}).encode()
    yield footer + len(footer).to_bytes(8, "little") + MAGIC


class Shard:
    """A shard: its index in memory, its ids read as they are asked for; keyed access in constant time."""

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        size, m = self.file.size(), len(MAGIC)
        if size < 2 * m + 8 or self.file.read_at(m, 0) != MAGIC or self.file.read_at(m, size - m) != MAGIC:
            raise ValueError("not a shard, or cut short")
        n = int.from_bytes(self.file.read_at(8, size - m - 8), "little")
        about = json.loads(self.file.read_at(n, size - m - 8 - n))
        self.width = about["width"]
        at, cut = m + about["ids"] * self.width, []
        for n in about["sections"]:
            cut.append(self.file.read_at(n, at))
            at += n
        self.records, self.slots = np.frombuffer(cut[0], _RECORD), np.frombuffer(cut[1], "<u4")
        self.index = PerfectHash(about["sizes"], np.frombuffer(cut[2], "<u8"), np.frombuffer(cut[3], "<u4"))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on."""
        return np.frombuffer(self.file.read_at(n * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def first_record(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 where there is none."""
        number = self.index.find(keys)
        out = np.full(len(number), -1, dtype=np.int64)
        out[number >= 0] = self.slots[number[number >= 0]]
        return out

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document."""
        at = int(self.first_record(np.array([key]))[0])
        if at < 0 or int(self.records[at]["key"]) != key:
            return None
        r = self.records[at]
        return self.ids(int(r["start"]), int(r["n"]))


def write_tokens(docs: DataFrame, *, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Write the shards and their manifest; returns the folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    make_folder(folder)
    run = uuid.uuid4().hex[:8]
    # the salt lets rows that repeat an id and its text go to several tasks
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"), salt.alias("salt"))
    size, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count("*")).first()
    order = ["doc_id", "mark", "salt"]
    tasks = max(1, -(-size // shard_bytes), -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, size >> 20))
    parts = texts.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        _writer(vocabulary, end_id, folder, run, shard_bytes), "part int, file string, first bigint, last bigint, docs bigint, ids bigint"
    )
    parts.write.parquet(f"{folder}/parts-{run}")
    # one row for each shard, and one task for all of them: a number of rows that shards of full size keep small
    by_place = Window.orderBy("part", "file")
    before = F.coalesce(F.sum("ids").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    manifest = spark.read.parquet(f"{folder}/parts-{run}").select((F.row_number().over(by_place) - 1).cast("bigint").alias("shard"), "file", "first", "last", "docs", "ids", before.alias("before"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def _writer(vocabulary: str, end_id: int, folder: str, run: str, shard_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, number = TaskContext.get().partitionId(), 0
        ids, keys, nulls, counts, size = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal number
            file = f"shard-{run}-{part:06d}-{number:06d}.ids"
            number += 1
            key, null, count = np.concatenate(keys), np.concatenate(nulls), np.concatenate(counts)
            put_file(f"{folder}/{file}", shard_parts(ids, key, null, count, width))
            known = key[~null]
            ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
            columns = [pa.array([part], pa.int32()), pa.array([file]), *(pa.array([e], pa.int64()) for e in ends), pa.array([len(key)]), pa.array([int(count.sum())])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "file", "first", "last", "docs", "ids"])

        for whole in batches:
            for batch in slices(whole, "text"):
                own, begin = coder.encode(batch.column("text"))
                ids.append(np.insert(own, begin[1:], end_id).astype(f"<u{width}"))
                counts.append(np.diff(begin) + 1)
                nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                keys.append(batch.column("doc_id").fill_null(0).to_numpy())
                size += max(batch.column("text").nbytes, 1)
                if size >= shard_bytes:
                    yield shard()
                    ids, keys, nulls, counts, size = [], [], [], [], 0
        if ids:
            yield shard()

    return write


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards, through their indexes: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids`` (unsigned 32-bit, little-endian)."""
    shards = _manifest(spark, folder).select("file", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with open_file(f"{folder}/{file}") as f:
                    yield from _documents(Shard(f), before)

    number = max(1, min(shards.count(), MOST_TASKS))
    return shards.repartition(number).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _documents(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
    r = shard.records
    null = r["null"] > 0
    found = shard.first_record(r["key"])
    led = null | ((found >= 0) & (r["key"][np.maximum(found, 0)] == r["key"]))
    if not led.all():
        raise ValueError("an index entry leads to another document")
    # a key's later records follow its first one
    at = np.where(null, np.arange(len(r)), found + np.arange(len(r)) - np.searchsorted(r["key"][~null], r["key"]) - null.sum())
    r = r[at]
    start, count = r["start"].astype(np.int64), r["n"].astype(np.int64)
    lo = 0
    while lo < len(r):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + (1 << 20), side="right")) - 1)  # about a million ids
        hi = min(hi, lo + 4096, len(r))
        p = slice(lo, hi)
        own = shard.ids(int(start[lo]), int(start[hi - 1] + count[hi - 1] - start[lo])).astype("<u4")
        bounds = np.append(start[p] - start[lo], len(own)) * 4
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(own.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["key"][p], mask=null[p]), pa.array(base + start[p]), pa.array(count[p]), data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
        )
        lo = hi


def lookup(spark: SparkSession, folder: str, keys: DataFrame, *, key_col: str = "doc_id") -> DataFrame:
    """The documents of some keys: ``doc_id``, ``n_tokens``, ``ids`` (null where there is none), one row for each distinct key.

    The first and last keys of all shards (16 bytes a shard) go to every task.
    """
    bounded_batches(spark)
    shards = _manifest(spark, folder)
    ends = shards.where("first IS NOT NULL").select("shard", "first", "last").orderBy("shard").toPandas()  # one row for each shard
    held = spark.sparkContext.broadcast(tuple(ends[c].to_numpy(dtype=np.int64) for c in ends.columns))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, last = held.value
        for b in batches:
            key = b.column("doc_id").to_numpy(zero_copy_only=False)
            k = np.searchsorted(last, key, side="left")  # the first shard that ends at the key or behind it
            inside = k < len(shard)
            inside[inside] = first[k[inside]] <= key[inside]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(inside, shard[np.minimum(k, len(shard) - 1)] if len(shard) else -1, -1), pa.int64())], names=["doc_id", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["shard"]):
            with open_file(f"{folder}/{g['file'][0].as_py()}") as f:
                shard = Shard(f)
                for part in g.to_batches(256):
                    found = [shard.get(k) for k in part.column("doc_id").to_pylist()]
                    data = pa.array([None if x is None else x.astype("<u4").tobytes() for x in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else len(x) for x in found], pa.int64()), data], names=["doc_id", "n_tokens", "ids"])

    asked = keys.select(F.col(key_col).cast("bigint").alias("doc_id")).distinct()
    placed = asked.where("doc_id IS NOT NULL").mapInArrow(place, "doc_id bigint, shard bigint")
    near = placed.join(shards.select("shard", "file"), "shard").repartition("shard").sortWithinPartitions("shard", "doc_id")
    nothing = [F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("binary").alias("ids")]
    absent = placed.where("shard < 0").select("doc_id").unionAll(asked.where("doc_id IS NULL")).select("doc_id", *nothing)
    return near.mapInArrow(read, "doc_id bigint, n_tokens bigint, ids binary").unionAll(absent)
