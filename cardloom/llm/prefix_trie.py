"""Prefix trie of conversations: which of them begin with the same turns, and what sharing those saves.

A conversation is a string whose letters are its turns. Turns are 128-bit digests of role and text,
and a prefix is the digest of its turns, chained; texts are never shuffled. Equal conversations
become one string. The trie is cut at prefixes of at most ``GROUP`` different strings (prefixes of
more are counted first, with partial sums on the map side); below each cut, in one task, stands a
z-fast trie:

* compacted nodes, each the end of an edge over several turns, are hashed at their handle, the prefix
  whose length is the two-fattest number on the edge;
* a fat binary search over those handles finds where a string leaves the trie, in as many looks as
  its length has bits;
* strings go in by batches: a batch looks up all its exits first, then the strings of each exit are
  put in below it, where an edge is split at most once for each;
* last, edges are expanded to a row for each turn.

What lies above the cuts is summed over the roots of the groups. Everything grows with the turns,
whatever is shared: copies of a conversation are counted in blocks of neighbouring ids before they
meet, so that a text with a third of all ids is as many rows as it has blocks.

Defined results: rows without an integer ``conv_id`` belong to no conversation; null role or text is
empty; turns in ascending order, null first, equal ones by the digest of what they say; a conversation
without turns is a member of the root alone; no rows give no nodes. Other columns are ignored. One
conversation's digests (24 bytes a turn) are held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import BROADCAST_ROWS, bounded_batches, quoted, written

#: Most different strings below a cut, all in one task; strings of a batch of insertions.
GROUP, BATCH = 4096, 256
#: Ids of one block: neighbours that are joined to one text before equal conversations meet.
BLOCK = 4096
WIDTH = 16
_NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


# ------------------------------------------------------------------------ conversations
def turn_rows(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: in order, the digest of each turn and the code points of its text."""
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.col(quoted(turn_col))
    key = F.substring(F.unhex(F.sha2(said, 256)), 1, WIDTH)
    rows = convs.select(F.col(quoted(conv_col)).try_cast("bigint").alias("conv_id"), F.struct(turn.isNotNull().alias("set"), turn.alias("turn"), key.alias("key"), F.length(text).cast("bigint").alias("chars")).alias("t"))
    rows = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(rows: DataFrame, start_of: Column, length: Column, most: int) -> DataFrame:
    """Conversations whose first ``length`` (at most ``most``) turns are those of conversation ``start_of`` (none, if absent)."""
    rows = rows.withColumns({"start_of": start_of, "take": length})
    starts = rows.where("conv_id = start_of").select("start_of", F.slice("turns", 1, most).alias("first"))
    rows = rows.join(starts, "start_of", "left")
    none = F.array().cast(rows.schema["turns"].dataType)
    own = F.slice("turns", F.col("take") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("take")), none), own).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path``: the digests of all prefixes of a conversation, the empty one first."""
    for b in batches:
        paths, ends, chars = [], [], []
        for turns in b.column("turns").to_pylist():
            now = bytes(WIDTH)
            path = [now]
            for t in turns:
                now = hashlib.blake2b(now + t["key"], digest_size=WIDTH).digest()
                path.append(now)
            paths.append(b"".join(path))
            ends.append(now)
            chars.append([t["chars"] for t in turns])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(ends, pa.binary()), pa.array(paths, pa.binary()), pa.array(chars, pa.list_(pa.int64()))], names=["conv_id", "mark", "path", "chars"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each mark, from its blocks in order; the ids are hashed as they pass."""
    held: list | None = None
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*([*r[:5], r[5].hexdigest()] for r in out), strict=True)) or [[]] * 6
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["mark", "path", "chars", "least", "n_convs", "ends"])

    for b in batches:
        for mark, path, chars, least, n, ids in zip(*(b.column(c).to_pylist() for c in ("mark", "path", "chars", "least", "n", "ids")), strict=True):
            if held is None or held[0] != mark:
                if held is not None:
                    out.append(held)
                held = [mark, path, chars, least, n, hashlib.sha256(ids.encode())]
            else:
                held[4] += n
                held[5].update(b"," + ids.encode())
        if len(out) >= 1000:
            yield flush()
            out = []
    if held is not None:
        out.append(held)
    yield flush()


def distinct_strings(rows: DataFrame) -> DataFrame:
    """``mark``, ``path``, ``chars``, ``least`` (id), ``n_convs`` and ``ends`` (digest of its ids) of each different conversation."""
    paths = rows.mapInArrow(_chained, "conv_id bigint, mark binary, path binary, chars array<bigint>")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = paths.groupBy("mark", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.first("path").alias("path"), F.first("chars").alias("chars"), F.min("conv_id").alias("least"), F.count("*").alias("n"), ids.alias("ids"))
    return blocks.repartition("mark").sortWithinPartitions("mark", "block").mapInArrow(_merged, "mark binary, path binary, chars array<bigint>, least bigint, n_convs bigint, ends string")


# ---------------------------------------------------------------------------- one group
def fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the largest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """Compacted nodes hashed at their handles, over strings given by the digests of their prefixes.

    All strings share the prefix of length ``top + 1``. A node is the end of an edge from depth ``low``
    (without) to ``high``; ``text`` is a string that runs through it.
    """

    def __init__(self, top: int):
        self.low: list[int] = []
        self.high: list[int] = []
        self.text: list[bytes] = []
        self.parent: list[int] = []
        self.ends: list[int] = []  # the string that ends in a node, or -1
        self.top = top
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}  # the edge that begins with a prefix

    @staticmethod
    def prefix(path: bytes, n: int) -> bytes:
        return path[WIDTH * n : WIDTH * (n + 1)]

    def _handle(self, v: int) -> bytes:
        return self.prefix(self.text[v], fattest(self.low[v], self.high[v]))

    def _add(self, low: int, high: int, path: bytes, parent: int) -> int:
        v = len(self.low)
        for column, x in ((self.low, low), (self.high, high), (self.text, path), (self.parent, parent), (self.ends, -1)):
            column.append(x)
        self.handles[self._handle(v)] = v
        self.first[self.prefix(path, low + 1)] = v
        return v

    def exit(self, path: bytes, below: int = -1) -> int:
        """The deepest node, under ``below``, whose whole prefix begins the string; -1: none. A fat binary search."""
        n = len(path) // WIDTH - 1
        a, b, found = self.high[below] if below >= 0 else self.top, n, below
        while a < b:
            f = fattest(a, b)
            v = self.handles.get(self.prefix(path, f), -1)
            if v < 0:
                b = f - 1
            elif self.high[v] <= n and self.prefix(path, self.high[v]) == self.prefix(self.text[v], self.high[v]):
                a, found = self.high[v], v
            else:  # the string leaves this very edge
                b = self.low[v]
        return found

    def _shared(self, path: bytes, v: int) -> int:
        """How far the string follows the edge of a node whose first turn it has."""
        a, b = self.low[v] + 1, min(self.high[v], len(path) // WIDTH - 1)
        while a < b:
            m = (a + b + 1) // 2
            a, b = (m, b) if self.prefix(path, m) == self.prefix(self.text[v], m) else (a, m - 1)
        return a

    def insert(self, path: bytes, name: int, below: int) -> None:
        """Put a string in, whose exit lay at or under ``below`` when its batch was looked up."""
        n = len(path) // WIDTH - 1
        v = self.exit(path, below)
        at = self.high[v] if v >= 0 else self.top
        if at < n:
            edge = self.first.get(self.prefix(path, at + 1), -1)
            if edge >= 0:
                cut = self._shared(path, edge)
                del self.handles[self._handle(edge)]
                self.low[edge] = cut
                v = self._add(at, cut, path, v)
                self.parent[edge] = v
                self.handles[self._handle(edge)] = edge
                self.first[self.prefix(self.text[edge], cut + 1)] = edge
                at = cut
            if at < n:
                v = self._add(at, n, path, v)
        self.ends[v] = name

    def insert_all(self, paths: list[bytes]) -> None:
        for lo in range(0, len(paths), BATCH):
            exits = sorted((self.exit(paths[k]), k) for k in range(lo, min(lo + BATCH, len(paths))))
            for below, k in exits:
                self.insert(paths[k], k, below)

    def expanded(self, chars: list[list[int]], least: list[int], counts: list[int], ends: list[str]) -> Iterator[tuple]:
        """(conv_id, depth, parent's conv_id or None, n_convs, n_children, n_leaves, saved_tokens, ends) of each turn of each edge."""
        size = len(self.low)
        n, small, leaves, children, below = [0] * size, [1 << 63] * size, [0] * size, [0] * size, [0] * size
        rows = []
        some = self._strings(size)
        for v in sorted(range(size), key=lambda v: -self.high[v]):
            if (k := self.ends[v]) >= 0:
                n[v], small[v] = n[v] + counts[k], min(small[v], least[k])
            leaves[v] = leaves[v] or 1
            total, last = below[v], chars[some[v]]
            for d in range(self.high[v], self.low[v], -1):
                total += (n[v] - 1) * last[d - 1]
                rows.append((v, d, children[v] if d == self.high[v] else 1, total, ends[self.ends[v]] if d == self.high[v] and self.ends[v] >= 0 else _NOTHING))
            if (p := self.parent[v]) >= 0:
                n[p] += n[v]
                small[p] = min(small[p], small[v])
                leaves[p] += leaves[v]
                children[p] += 1
                below[p] += total
        for v, d, c, total, mark in rows:
            parent = small[v] if d > self.low[v] + 1 else small[self.parent[v]] if self.parent[v] >= 0 else None
            yield small[v], d, parent, n[v], c, leaves[v], total, mark

    def _strings(self, size: int) -> list[int]:
        """A string that runs through each node."""
        some = list(self.ends)
        for v in sorted(range(size), key=lambda v: -self.high[v]):
            if (p := self.parent[v]) >= 0 and some[p] < 0:
                some[p] = some[v]
        return some


_GROUPED = f"{NODE}, root int, path binary, chars array<bigint>"


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each group of strings (a row with ``root`` 1: the group's first, with its path), and strings that end above all cuts (``root`` 2)."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _GROUPED.split(", ")]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def close(group: list[tuple], cut: int) -> None:
        paths, chars, least, counts, ends = zip(*group, strict=True)
        if len(paths[0]) // WIDTH - 1 < cut:
            d = len(paths[0]) // WIDTH - 1
            out.append((least[0], d, None, counts[0], 0, 0, 0, ends[0], 2, paths[0], chars[0]))
            return
        trie = ZFastTrie(cut - 1)
        trie.insert_all(list(paths))
        for row in trie.expanded(chars, least, counts, ends):
            is_root = row[1] == cut
            out.append((*row, int(is_root), paths[0][: WIDTH * (cut + 1)] if is_root else None, chars[0][:cut] if is_root else None))

    now, group, cut = None, [], 0
    for b in batches:
        for key, deep, *row in zip(*(b.column(c).to_pylist() for c in ("key", "cut", "path", "chars", "least", "n_convs", "ends")), strict=True):
            if key != now and group:
                close(group, cut)
                group = []
                if len(out) >= 4096:
                    yield flush()
                    out = []
            now, cut = key, deep
            group.append(tuple(row))
    if group:
        close(group, cut)
    yield flush()


# ------------------------------------------------------------------------- the whole trie
def _prefix(path: str, depth: Column | str) -> Column:
    return F.expr(f"substring({path}, {WIDTH} * {depth} + 1, {WIDTH})")


def nodes(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """A row for each node of the trie of ``rows`` (conv_id and turns, as ``turn_rows`` gives them)."""
    bounded_batches(rows.sparkSession)
    strings = written(distinct_strings(rows).withColumn("n", (F.octet_length("path") / WIDTH - 1).cast("int")), "strings")
    each = strings.where("n > 0").select("mark", "path", F.explode(F.sequence(F.lit(1), "n")).alias("d"))
    each = each.select("mark", "d", _prefix("path", "d").alias("key"))
    large = written(each.groupBy("key").count().where(F.col("count") > group).select("key"), "large-prefixes")
    known = large.count()
    if known:  # cuts go below the last prefix that too many strings share
        cuts = each.join(F.broadcast(large) if known <= BROADCAST_ROWS else large, "key").groupBy("mark").agg((F.max("d") + 1).alias("cut"))
        strings = strings.join(cuts, "mark", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    else:
        strings = strings.withColumn("cut", F.lit(1))
    dealt = strings.withColumn("key", F.when(F.col("n") >= F.col("cut"), _prefix("path", "cut")).otherwise(F.col("mark")))
    grown = written(dealt.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(_grown, _GROUPED), "trie")
    roots = grown.where("root > 0")

    # above the cuts: every root of a group, and every string that ends there, adds to the prefixes before it
    last = F.col("depth") - F.when(F.col("root") == 1, 1).otherwise(0)
    part = roots.select("*", last.cast("int").alias("last")).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("d"))
    under = F.aggregate(F.slice("chars", F.greatest("d", F.lit(1)), F.greatest(F.col("last") - F.greatest("d", F.lit(1)) + 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    part = part.select(
        _prefix("path", "d").alias("key"), F.when(F.col("d") > 0, _prefix("path", "(d - 1)")).alias("up"), F.col("d").cast("bigint").alias("depth"), F.coalesce(F.try_element_at("chars", F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("own"),
        "conv_id", "n_convs", "n_leaves", (F.col("saved_tokens") + F.col("n_convs") * under).alias("below"), ((F.col("root") == 1) & (F.col("d") == F.col("last"))).cast("bigint").alias("child"),
        F.when((F.col("root") == 2) & (F.col("d") == F.col("last")), F.col("ends_sha256")).alias("ends"),
    )
    above = part.groupBy("key").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("own").alias("own"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("below").alias("below"), F.sum("child").alias("child"), F.max("ends").alias("ends"),
    )
    above = written(above, "above")
    inner = above.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("inner"))
    # each node above the cuts counts its members once less; the first root under it knows the prefixes before it
    lines = above.select("conv_id", F.col("depth").cast("int").alias("at"), "own").join(roots.select("conv_id", "path"), "conv_id")
    once = lines.select("own", "path", F.explode(F.sequence(F.lit(0), "at")).alias("d")).groupBy(_prefix("path", "d").alias("key")).agg(F.sum("own").alias("once"))
    parents = above.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    top = above.join(inner, "key", "left").join(once, "key").join(parents, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("child") + F.coalesce("inner", F.lit(0))).alias("n_children"), "n_leaves", (F.col("below") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"),
    )
    names = [c.split()[0] for c in NODE.split(", ")]
    first = roots.where("root = 1").drop("parent_conv_id").withColumn("up", _prefix("path", "(depth - 1)")).join(parents, "up").select(*names)
    return grown.where("root = 0").select(*names).unionByName(first).unionByName(top)


def conversation_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The nodes of the trie of a table of conversations."""
    return nodes(turn_rows(convs, conv_col, turn_col, role_col, text_col), group)
