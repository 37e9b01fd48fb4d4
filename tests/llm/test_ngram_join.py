import random
import re

import numpy as np
import pytest

from cardloom.llm import graphs, ngram_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, n=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in link[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(link[i])))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    rows, i = [], 0
    for group, size in enumerate((1, 2, 3, 9, 40, 70)):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice((60, 200, 700)))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 60))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
        rows.append((i, " ".join(base).upper() + "!"))
        i += 1
    rows += [(1000, None), (1001, ""), (1002, "?!"), (1003, "two words"), (1004, "Two, words"), (1005, "long word " * 40_000), (1006, "long word " * 30_000)]
    lost = [f"q{i}" for i in range(100)]
    rows += [(None, " ".join(lost)), (None, " ".join([*lost[:99], "r1"])), (None, " ".join([*lost[:99], "r2"]))]
    half = [f"y{i}" for i in range(100)]
    rows += [(2005, " ".join(half)), (None, " ".join([*half[:99], "s1"])), (2007, " ".join([*half[:99], "s2"]))]
    rows += [(5, rows[5][1]), (6, "another text under an id that repeats here"), (None, rows[3][1]), (None, "lonely text without any id at all")]
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(5)
    got = ngram_join.near_duplicates(df, block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


@pytest.mark.parametrize("few", [0, 250_000])
def test_one_of_each_keeps_the_first(spark, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", few)
    rows = [*corpus(), (3000, None), (3000, None), (3001, "?")]
    names = "doc_id long, text string, _id string, _mark string, id int, mark int, node int, stays int"
    df = spark.createDataFrame([(*r, "i", "m", 1, 2, 3, 4) for r in rows], names)
    kept = ngram_join.one_of_each(df, ngram_join.near_duplicates(df))
    assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {("i", "m", 1, 2, 3, 4)}
    kept = [tuple(r)[:2] for r in kept.collect()]
    sets = {r: shingle_set(r[1]) for r in rows}
    left = [r for r in rows if sets[r]]
    classes = []
    while left:
        group, todo = [], [left[0]]
        while todo:
            group.append(todo.pop())
            todo += [r for r in left if r not in group and r not in todo and near(sets[group[-1]], sets[r])]
        left = [r for r in left if r not in group]
        classes.append(group)
    for group in classes:
        ids = [r[0] for r in group if r[0] is not None]
        own = [r for r in kept if r in group]
        assert len(own) == 1 and own[0][0] == (min(ids) if ids else None), group
    assert sorted(map(str, (r for r in kept if not sets[r]))) == sorted(map(str, (r for r in rows if not sets[r])))


def near(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(df).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    found = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    assert got == {i: 0 for i in range(61)} | {j: 100 for j in range(100, 160)} and len(found) == len(got)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed, monkeypatch):
    """Against union by hand; a low bound makes many nodes hot."""
    monkeypatch.setattr(graphs, "HOT_EDGES", 5)
    r = random.Random(seed)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(500 + i // 3, 500 + i) for i in range(60)] + [(900 - i, 1000) for i in range(40)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.component for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_no_edges(spark):
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_labels_of_joined_trees(seed):
    r = random.Random(seed)
    a, b = (np.array([r.randrange(30) for _ in range(25)]) for _ in range(2))
    label = list(range(30))
    for _ in range(30):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert ngram_join.merged(np.arange(30), a, b).tolist() == label


def test_pruning_keeps_likely_pairs_only():
    need = [ngram_join.least_matches(n, 0.8, 1e-6) for n in range(25, 126, 25)]
    assert all(0 < m < n for m, n in zip(need, range(25, 126, 25), strict=True))
    assert all(a < b for a, b in zip(need, need[1:], strict=False))
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    other = np.unique(np.concatenate([base[:889], r.integers(0, 1 << 63, 111).astype(np.uint64)]))
    sig = ngram_join.signatures(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
