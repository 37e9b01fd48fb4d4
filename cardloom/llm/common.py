"""Helpers shared by the corpus operators: sessions, shared folders, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch on its way to Python: long texts make larger batches dangerous.
BATCH_ROWS = 1000

#: Most rows of a few numbers each that are sent to every task.
BROADCAST_ROWS = 250_000

#: Bytes of text worked on at a time inside a task.
SLICE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of the session's Arrow batches, where they are more, so that one of long texts fits a small worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, on one machine only, as in tests, it is a folder under the
    warehouse; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        folder = own.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_texts(docs: DataFrame, marks: DataFrame, most: dict[int, int] | int, most_bytes: int, id_col: str, text_col: str) -> list[tuple]:
    """(id, text, label) of at most ``most`` of the ids of ``marks`` (doc_id, label), or so many of each label.

    Ids are taken in the order of a hash, an id of several texts has the least of them, and whole
    texts are taken while they fit into ``most_bytes`` together: the driver's part is bounded, whatever repeats.
    """
    parts = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in most.items()] if isinstance(most, dict) else [marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)]
    sample = F.broadcast(reduce(DataFrame.unionAll, parts))
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")).join(sample, "doc_id")
    texts = written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # no more rows than ``most``
    chosen, held = [], 0
    for r in sizes:  # a text that does not fit ends nothing: shorter ones behind it still may
        if held + r["size"] <= most_bytes:
            held += r["size"]
            chosen.append((r["doc_id"],))
    if len(chosen) < len(sizes):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, texts.select("doc_id").schema)), "doc_id")
    return [(r["doc_id"], r["text"], r["label"]) for r in texts.collect()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying them, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal integer keys, whole, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(key[lo]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, some at a time, from batches that are sorted by integer keys."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([table[c].to_numpy() for c in keys], axis=1)
        last = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1  # the last group may go on
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def quoted(column: str) -> str:
    """The name of a top-level column, whatever is in it."""
    return "`" + column.replace("`", "``") + "`"


def make_folder(uri: str) -> None:
    """Create a folder on any file system that pyarrow knows."""
    fs, path = _place(uri)
    fs.create_dir(path, recursive=True)


def put_file(uri: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of its own and move it into place: retries and twin tasks are harmless."""
    fs, path = _place(uri)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(aside) as out:
        for part in parts:
            out.write(part)
    fs.move(aside, path)


def exists(uri: str) -> bool:
    """Whether there is a file or folder of that name."""
    from pyarrow import fs

    system, path = _place(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def open_file(uri: str) -> pa.NativeFile:
    """A file to be read from any place."""
    system, path = _place(uri)
    return system.open_input_file(path)


def _place(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
