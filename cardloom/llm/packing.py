"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt at random into groups of about ``group_docs`` documents and ``GROUP_BYTES`` of
text; each group is packed on its own, in an order that a hash of its texts fixes. A document of
more than ``LONG_BYTES`` is a group by itself, so that no task holds several of them. A document is cut into pieces of a full sequence and a remainder; the remainders go, the
longest first, each to the first sequence that still has room, which a tournament tree over the
sequences' free places finds in logarithmic time. Last, the emptiest sequences are poured into
the gaps of the others, the widest gaps first, which cuts a few remainders once more and leaves
less than one sequence of padding to a group.

Defined results: null and empty texts are their end id alone; rows that repeat are packed each;
no rows give no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import bounded_batches, groups, slices
from cardloom.llm.tokens import encoder

LENGTH = 1024
GROUP_DOCS = 2048
#: Bytes of text of a group, on average; bytes from which a text is a group by itself.
GROUP_BYTES, LONG_BYTES = 16 << 20, 4 << 20
#: Most tasks; below, there are as many as groups.
MOST_TASKS = 20_000
SEED = 20240607

#: (item, start in its document, length, bin, offset in the bin)
Piece = tuple[int, int, int, int, int]


class Tournament:
    """Free places of bins in a row; a parent holds the larger of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for ``size``, which it then holds."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """The items of each bin."""
    tree = Tournament(len(sizes), room)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = tree.take(sizes[item])
        if k == len(bins):
            bins.append([])
        bins[k].append(item)
    return bins


def pack(sizes: list[int], room: int = LENGTH) -> list[Piece]:
    """The pieces of documents of the given numbers of tokens, each of at least one."""
    out: list[Piece] = []
    number = 0
    rest = []
    for item, n in enumerate(sizes):
        for start in range(0, n - room + 1, room):
            out.append((item, start, room, number, 0))
            number += 1
        if n % room:
            rest.append((item, n - n % room, n % room))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], room)]
    used = [sum(r[2] for r in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -used[k])
    needed = -(-sum(used) // room)
    poured = [r for k in order[needed:] for r in bins[k]]
    gaps = sorted(order[:needed], key=lambda k: used[k])
    g = 0
    for item, start, n in poured:
        while n:
            k = gaps[g]
            part = min(n, room - used[k])
            if part:
                bins[k].append((item, start, part))
                used[k] += part
                start, n = start + part, n - part
            if used[k] == room:
                g += 1
    for k in order[:needed]:
        at = 0
        for item, start, n in bins[k]:
            out.append((item, start, n, number, at))
            at += n
        number += 1
    return out


def pack_documents(
    docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH,
    group_docs: int = GROUP_DOCS, seed: int = SEED,
) -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``
    and ``ids`` (unsigned 32-bit, little-endian)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows, held = texts.agg(F.count("*"), F.coalesce(F.sum(F.when(size <= LONG_BYTES, size.cast("bigint"))), F.lit(0))).first()
    number = max(1, -(-rows // group_docs), -(-held // GROUP_BYTES))
    draw = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    group = F.when(size > LONG_BYTES, F.lit(number) + F.pmod(draw, F.lit(1 << 30))).otherwise(F.pmod(draw, F.lit(number)))
    dealt = texts.withColumns({"group": group, "mark": F.xxhash64("text", F.lit(seed))})
    kind = texts.schema["doc_id"].dataType.simpleString()
    tasks = min(number, MOST_TASKS)
    return dealt.repartition(tasks, "group").sortWithinPartitions("group", "mark", "doc_id").mapInArrow(
        _packer(vocabulary, end_id, length),
        f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary",
    )


def _packer(vocabulary: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for table in groups(batches, ["group"]):
            ids, begin = [], [0]
            for part in (piece for batch in table.to_batches() for piece in slices(batch, "text")):
                own, at = coder.encode(part.column("text"))
                ends = np.insert(own, at[1:], end_id)
                ids.append(ends)
                begin += (begin[-1] + at[1:] + np.arange(1, len(at))).tolist()
            flat = np.concatenate(ids).astype("<u4")
            sizes = np.diff(begin)
            pieces = np.array(pack(sizes.tolist(), length), dtype=np.int64).T
            item, start, size, sequence, offset = pieces
            at = np.asarray(begin)[item] + start
            order = np.argsort(at, kind="stable")  # pieces lie in the texts' order: their ids are one buffer
            item, start, size, sequence, offset = (x[order] for x in (item, start, size, sequence, offset))
            group = table["group"][0].as_py()
            bounds = np.concatenate(([0], np.cumsum(size))) * 4
            doc = table["doc_id"].combine_chunks().take(pa.array(item))
            for lo in range(0, len(item), 4096):
                p = slice(lo, lo + 4096)
                cut = bounds[lo : lo + 4096 + 1]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).tobytes()), pa.py_buffer(flat[cut[0] // 4 : cut[-1] // 4].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [doc[p], pa.array(start[p]), pa.array(size[p]), pa.array(sizes[item[p]]), pa.array((group << 32) + sequence[p]), pa.array(offset[p]), data.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run
