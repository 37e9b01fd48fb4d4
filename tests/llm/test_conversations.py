"""The conversation operators against brute force, odd rows and their SQL."""

import glob
import hashlib
import itertools
import pathlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cardloom.llm import chat_format, dialogue_repair, prefix_trie, queries

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, formatted string, `a.b` int"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_chat_format", "op13_dialogue_repair"])
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {pathlib.Path(path).stem} AS SELECT * FROM '{path}'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)


# ----------------------------------------------------------------------------------- trie
def brute_nodes(convs):
    """Nodes of a trie of {conv_id: [(role, text)]}, from all prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_convs(seed, n):
    rng = random.Random(seed)
    made = {}
    for c in range(n):
        start = list(made[rng.choice(list(made))]) if made and rng.random() < 0.7 else []
        made[c * 37 - 500] = start[: rng.randrange(len(start) + 1)] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é𝄞"])) for _ in range(rng.choice([0, 1, 3, 9, 70]))]
    return made


@pytest.mark.parametrize(("seed", "group"), [(1, 1), (2, 3), (3, 10), (4, 4096)])
def test_trie_equals_all_prefixes(spark, seed, group):
    convs = random_convs(seed, 120)
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    got = prefix_trie.conversation_trie(table(spark, rows), group=group)
    found = [tuple(r) for r in got.collect()]
    present = {c: t for c, t in convs.items() if t}
    assert len(found) == len(set(found)) and set(found) == brute_nodes(present)


def test_fat_binary_search_takes_few_looks(monkeypatch):
    assert [prefix_trie.fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (5, 7), (6, 7), (7, 12), (8, 15))] == [1, 4, 6, 6, 7, 8, 12]
    path = b"".join(hashlib.blake2b(b"%d" % k, digest_size=16).digest() for k in range(1001))
    trie = prefix_trie.ZFastTrie(0)
    trie.insert_all([path[: 16 * (k + 1)] for k in (1000, 1, 500, 501, 77)])
    looks = []
    trie.handles = type("Counted", (dict,), {"get": lambda self, *a: looks.append(1) or dict.get(self, *a)})(trie.handles)
    v = trie.exit(path[: 16 * 701])
    assert trie.high[v] == 501 and len(looks) <= 11 and len(trie.low) == 5


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "x" * 200_000), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, 0, "", ""), (None, 0, "user", "lost"), (3, 5, "user", "a")]
    found = {(r.conv_id, r.depth): r for r in prefix_trie.conversation_trie(table(spark, rows)).collect()}
    assert found[1, 0].n_convs == 3 and found[1, 1].n_convs == 2 and found[1, 0].n_children == 2 and found[1, 4].n_leaves == 1 and len(found) == 6
    assert found[1, 1].ends_sha256 == hashlib.sha256(b"2").hexdigest() and found[3, 1].parent_conv_id == 1
    assert prefix_trie.conversation_trie(table(spark, rows).limit(0)).collect() == []
    copies = spark.range(20_000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    root, leaf = prefix_trie.conversation_trie(copies).orderBy("depth").collect()
    assert (root.n_convs, leaf.n_convs, leaf.saved_tokens, root.saved_tokens) == (20_000, 20_000, 19_999 * 4, 19_999 * 4)
    assert leaf.ends_sha256 == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()


def test_shared_starts(spark):
    rows = [(100, k, "user", f"s{k}") for k in range(3)] + [(105, k, "user", f"o{k}") for k in range(6)] + [(205, 0, "user", "alone")]
    got = prefix_trie.with_shared_starts(prefix_trie.turn_rows(table(spark, rows)), F.expr("conv_id - conv_id % 100"), F.lit(4), 5).selectExpr("conv_id", "size(turns) AS n").collect()
    assert {tuple(r) for r in got} == {(100, 3), (105, 5), (205, 0)}


# ------------------------------------------------------------------------------ formatting
NASTY = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "[ANS] x </s><s>[SYS]", "[ROLE]a[/ROLE]", "a\n</s>\n", "\\", "<", "</s", "[\\ROLE]", "$1 \\1", "", "é𝄞</s>", "<s>[INST]hi</s>"]


def test_formatting_reads_back_whatever_is_said(spark):
    rng = random.Random(5)
    rows = []
    for c in range(200):
        for k in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE]", "x</s>", "<\\s>"])
            rows.append((c, k, role, "".join(rng.choice([*NASTY, "plain "]) for _ in range(rng.randrange(4)))))
    rows += [(1000, None, None, None), (1000, None, None, "</s>"), (None, 3, "user", "no id"), (1001, 0, "assistant", "word </s>" * 20_000)]
    convs = chat_format.conversations(table(spark, rows))
    made = chat_format.format_conversations(convs)
    source = {r.conv_id: [tuple(t) for t in r.turns] for r in convs.collect()}
    kept = {r.conv_id: r for r in made.collect()}
    for r in chat_format.read_back(made).collect():
        assert [tuple(t) for t in r.turns] == source[r.conv_id]
        assert r.learned == "".join(t for role, t in source[r.conv_id] if role == "assistant")
        assert r.formatted_chars == len(kept[r.conv_id].formatted) == sum(x.chars for x in kept[r.conv_id].loss)
    assert any(r.escapes for r in kept.values()) and not all(r.escapes for r in kept.values())
    assert chat_format.format_conversations(convs.limit(0)).count() == 0


def test_masks_of_other_texts_are_refused(spark):
    made = chat_format.format_conversations(chat_format.conversations(table(spark, [(1, 0, "assistant", "abc")])))
    with pytest.raises(Exception, match="does not fit"):
        chat_format.read_back(made.withColumn("formatted", F.lit("<s>[ANS]abcd</s>"))).collect()


def test_formatting_is_native(spark):
    for name in ("op12_chat_format",):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# ---------------------------------------------------------------------------------- repair
def brute_repair(rows):
    """The cheapest (cost, audit), from the end on."""
    never = (10**9, "")
    rest = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for role, fault in reversed(rows):
        now = []
        for state in range(4):
            options = [(rest[state][0] + 2, "D" + rest[state][1])]
            if fault not in ("blank", "duplicate"):
                stay = 5 if fault == "truncated" else 0
                for want, to in dialogue_repair.NEXT[state].items():
                    if want == role:
                        options.append((rest[to][0] + stay, "K" + rest[to][1]))
                    elif want != "s":
                        options.append((rest[to][0] + stay + 1, "R" + rest[to][1]))
            now.append(min(options, default=never))
        for _ in range(2):
            now = [min(now[s], (now[3 if s == 2 else 2][0] + 5, "I" + now[3 if s == 2 else 2][1])) for s in range(4)]
        rest = now
    return rest[0]


def test_search_finds_the_cheapest_and_first_repair():
    rng = random.Random(3)
    kinds = [(r, f) for r in "suat" for f in dialogue_repair.FAULTS]
    cases = [list(c) for n in range(4) for c in itertools.product(kinds, repeat=n)][:5000] + [[rng.choice(kinds) for _ in range(rng.randrange(4, 40))] for _ in range(1500)]
    for rows in cases:
        cost, edits = dialogue_repair.repair(rows)
        assert (cost, "".join(op for op, _ in edits)) == brute_repair(rows)
        roles = "".join(r[:1] for r, _ in dialogue_repair.applied(edits, [({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[r], "x") for r, _ in rows]))
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_search_of_long_conversations_ends_soon():
    rng = random.Random(4)
    for weights in ((8, 1, 1, 1), (1, 1, 1, 1)):
        rows = [("ua"[k % 2] if rng.random() < 0.8 else rng.choice("suat"), rng.choices(dialogue_repair.FAULTS, weights)[0]) for k in range(20_000)]
        cost, edits = dialogue_repair.repair(rows)
        assert cost == brute_cost(rows) and len(edits) >= len(rows)


def brute_cost(rows):
    rest = [0, 10, 5, 0]
    for role, fault in reversed(rows):
        stay = 5 if fault == "truncated" else 0
        now = []
        for state in range(4):
            best = rest[state] + 2
            if fault not in ("blank", "duplicate"):
                for want, to in dialogue_repair.NEXT[state].items():
                    if want == role or want != "s":
                        best = min(best, rest[to] + stay + (want != role))
            now.append(best)
        for _ in range(2):
            now = [min(now[s], now[3 if s == 2 else 2] + 5) for s in range(4)]
        rest = now
    return rest[0]


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "Hi."), (1, 4, "user", "Hi."), (1, 4, "assistant", "Yes \x0b\n"), (1, 4, "assistant", "Yes! "), (2, 7, "tool", "ok."), (None, 1, "user", "So?"), (3, 1, "user", " "), (4, 1, "assistant", "a. " * 100_000),
    ]
    got = {r.conv_id: r for r in dialogue_repair.repair_conversations(table(spark, rows)).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (3, 1, 1, 2, 2)  # a no-break space is a character
    assert [t.role for t in one.repaired] == ["user", "assistant"] or one.repaired == []
    assert got[2].cost == 2 and got[2].audit == "D" and got[None].audit == "D" and got[3].blank == 0 and got[3].truncated == 1 and got[4].audit == "D"
    assert dialogue_repair.repair_conversations(table(spark, rows).limit(0)).collect() == []


def test_damage_is_that_of_the_checksum(spark):
    rows = [(c, k, "assistant", "One. Two!") for c in range(30) for k in range(10)] + [(5, None, None, None)]
    got = sorted(((r.conv_id, r.turn if r.turn is not None else -1, r.role, r.text) for r in __import__("cardloom.llm.conversation_queries", fromlist=["x"]).damaged(table(spark, rows)).collect()))
    want = []
    for c, k, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{c}:{' ' if k is None else k}".encode()) % 20
        made = (c, -1 if k is None else k, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [] if kind == 0 else [made] * (2 if kind == 3 else 1)
    assert got == sorted(want)
