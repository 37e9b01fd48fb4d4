"""Repair of a conversation's structure at the least cost, by depth-first branch and bound.

Roles must read ``(system? (user assistant)+)?``. A row is kept (K, costs nothing), given another role,
user or assistant (R, 1), or deleted (D, 2), and a turn of either role without text is inserted (I, 5)
anywhere. Blank rows and repeats of an earlier role and text must be deleted; a truncated row that
stays costs 5 more. Of all cheapest repairs the one whose edits, written in order, come first in ASCII
is taken.

One node of the search is (rows read, state of the grammar); a path to it is a cost and an audit. An
explicit stack holds the paths to be followed, the most promising on top; a lower bound of what the
rest of the rows costs in each state, counted backwards over costs alone, cuts paths that can't reach
the incumbent, the best whole (cost, audit) so far; and a table of each node's best path cuts those
that come to it later with a worse one. Both are safe: whatever ends a path, ends a better one to the
same node better. The search stops when the stack is empty, which proves the incumbent. As the bounds
are tight, it looks at few paths beside it: a looser bound that let system turns stand anywhere did not
end in minutes on 20,000 rows. Audits are chains that share their beginnings, so that memory grows with the rows.

Conversations are dealt by id and sorted, and each is searched in one task; rows pass in order and
those of one conversation at a time are held. Defined results: null ids, roles and texts are kept
apart from others by ``conv_id`` null being one conversation and null role or text one space; turns
in ascending order, null first, equal ones by role and text; no rows give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import bounded_batches, quoted

SPACES = "\x09-\x0d\x20"
FAULTS = ("", "blank", "duplicate", "truncated")
KEPT = 5  # what a truncated row costs that stays
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
NEVER = 1 << 60
#: States: nothing yet; a system turn; a user turn; an assistant turn. What may come next: role to state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WHOLE = (0, 3)

#: (initial of the role, fault)
Row = tuple[str, str]


class Edit:
    """The last edit of a path, and the path before it."""

    __slots__ = ("before", "length", "op", "row")

    def __init__(self, op: str, row: int, before: Edit | None):
        self.op, self.row, self.before, self.length = op, row, before, before.length + 1 if before else 1


def comes_first(a: Edit | None, b: Edit | None) -> bool:
    """Whether the audit of ``a`` is less than that of ``b``: back to where they part."""
    la, lb = a.length if a else 0, b.length if b else 0
    less = la < lb  # if one begins the other
    x, y = a, b
    for _ in range(la - lb):
        x = x.before
    for _ in range(lb - la):
        y = y.before
    while x is not y:
        if x.op != y.op:
            less = x.op < y.op
        x, y = x.before, y.before
    return less


def moves(row: Row | None, state: int) -> list[tuple[str, int, int]]:
    """(initial, state after it, cost) of the edits that may follow; all but I take up the row."""
    answer = "a" if state == 2 else "u"
    out = [("I", NEXT[state][answer], COST["I"])]
    if row is None:
        return out
    role, fault = row
    out.append(("D", state, COST["D"]))
    if fault not in ("blank", "duplicate"):
        stay = KEPT if fault == "truncated" else 0
        if role in NEXT[state]:
            out.append(("K", NEXT[state][role], stay))
        if role != answer:
            out.append(("R", NEXT[state][answer], stay + COST["R"]))
    return out


def lower_bounds(rows: list[Row]) -> list[list[int]]:
    """What the rows from each place on cost at least, in each state."""
    after = [0, NEVER, NEVER, 0]
    out = []
    for row in (None, *reversed(rows)):
        here = [min((price + after[to] for op, to, price in moves(row, s) if op != "I"), default=after[s]) for s in range(4)]
        # no cheapest repair inserts more than two turns in a row
        for _ in range(2):
            here = [min(c, COST["I"] + here[NEXT[s]["a" if s == 2 else "u"]]) for s, c in enumerate(here)]
        out.append(here)
        after = here
    return out[::-1]


class Incumbent:
    """The best whole repair so far, and the edit that follows each point of its path."""

    def __init__(self, cost: int, path: Edit | None):
        self.cost, self.path = cost, path
        self.then: dict[Edit | None, str] = {}
        while path:
            self.then[path.before] = path.op
            path = path.before

    def is_before(self, path: Edit | None) -> bool:
        """Whether no end of ``path`` has an audit that comes before the incumbent's."""
        op = None
        while path is not self.path and path not in self.then:
            op, path = path.op, path.before
        return op is not None and (path is self.path or op > self.then[path])


def repair(rows: list[Row]) -> tuple[int, list[tuple[str, int]]]:
    """The least cost, and the edits (initial, row or -1) of the first of the cheapest repairs."""
    bounds = lower_bounds(rows)
    n = len(rows)
    best: Incumbent | None = None
    known: dict[tuple[int, int], tuple[int, Edit | None]] = {}
    stack: list[tuple[int, int, int, Edit | None]] = [(0, 0, 0, None)]
    while stack:
        at, state, cost, path = stack.pop()
        least = cost + bounds[at][state]
        if best and (least > best.cost or (least == best.cost and best.is_before(path))):
            continue
        seen = known.get((at, state))
        if seen and (cost > seen[0] or (cost == seen[0] and not comes_first(path, seen[1]))):
            continue
        known[at, state] = (cost, path)
        if at == n and state in WHOLE and (best is None or cost < best.cost or comes_first(path, best.path)):
            best = Incumbent(cost, path)
        follow = [(cost + price + bounds[at + (op != "I")][to], op, to, price) for op, to, price in moves(rows[at] if at < n else None, state)]
        # the least promising at the bottom; of equals, the first letter on top
        for _, op, to, price in sorted(follow, reverse=True):
            stack.append((at + (op != "I"), to, cost + price, Edit(op, at if op != "I" else -1, path)))
    edits, path = [], best.path
    while path:
        edits.append((path.op, path.row))
        path = path.before
    return best.cost, edits[::-1]


def applied(edits: list[tuple[str, int]], said: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text)."""
    out: list[tuple[str, str]] = []
    state = 0
    for op, k in edits:
        if op == "D":
            continue
        role = said[k][0] if op == "K" else "assistant" if state == 2 else "user"
        out.append((role, said[k][1] if k >= 0 else ""))
        state = NEXT[state][role[:1]]
    return out


# -------------------------------------------------------------------------- all conversations
def _inner(text: Column, fault: str) -> Column:
    return text.rlike(rf"[^{SPACES}]") if fault == "blank" else text.rlike(rf"[^.!?{SPACES}][{SPACES}]*\z")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    kind = None
    now: object = _repaired  # no id
    held: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        turns = [t for t, *_ in held if t is not None]
        said = [(role, text) for _, role, text, *_ in held]
        earlier: set[tuple[str, str]] = set()
        rows, counts = [], dict.fromkeys(FAULTS, 0)
        for _, role, text, full, cut in held:
            fault = "blank" if not full else "duplicate" if (role, text) in earlier else "truncated" if cut else ""
            earlier.add((role, text))
            counts[fault] += 1
            rows.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, edits = repair(rows)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        fixed = [{"role": r, "text": t} for r, t in applied(edits, said)]
        out.append((now, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(op for op, _ in edits), fixed))

    def flush() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out.clear()
        return batch

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "full", "cut")), strict=True):
            if held and conv != now:
                close()
                held = []
                if len(out) >= 200:
                    yield flush()
            now = conv
            held.append(tuple(row))
    if held:
        close()
    if kind is not None:
        yield flush()


def repair_conversations(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: ``gaps`` in its turns, rows by fault, ``illegal`` neighbours, ``cost``, ``audit`` and ``repaired`` (role, text)."""
    bounded_batches(convs.sparkSession)
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = convs.select(F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"full": _inner(F.col("text"), "blank"), "cut": _inner(F.col("text"), "truncated")})
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    return dealt.mapInArrow(_repaired, f"conv_id {kind}, {counts}, audit string, repaired array<struct<role:string, text:string>>")
