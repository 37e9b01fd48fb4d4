import numpy as np
import pytest

from cardloom.llm import ann, queries


def exact(rows, asked, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q, v in asked:
        s = x @ np.array(v, dtype=np.float64)
        order = [i for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = answers(queries.op5_nearest(spark, f"/root/testdata/{sf}"))
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = 0
    truth = {r[0]: np.array(r[1], dtype=np.float64) for r in rows}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[1] != q and abs(f[2] - truth[q] @ truth[f[1]]) < 1e-12 for f in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.95


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 6)).round(3)
    rows = [(i, base[i].tolist(), "x") for i in range(30)] + [(100 + i, base[3].tolist(), "x") for i in range(60)]
    bad = [(900, None, "x"), (901, [], "x"), (902, [0.0] * 6, "x"), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (904, [float("nan")] * 6, "x"), (905, [float("inf")] * 6, "x"), (906, [1.0] * 5, "x"), (None, [1.0] * 6, "x"), (7, base[7].tolist(), "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string")
    asked = df.where("vec_id IN (3, 7, 105, 902, 906)")
    got = answers(ann.nearest(df, asked, k=5, target=1.0))
    want = exact([x[:2] for x in rows], [(i, base[3 if i in (3, 105) else i].tolist()) for i in (3, 7, 105)], 5)
    assert {q: [f[1] for f in found] for q, found in got.items()} == {q: [w[0] for w in v] for q, v in want.items()}
    few = df.where("vec_id IN (1, 2)")
    assert {q: len(v) for q, v in answers(ann.nearest(few, few, k=5, target=1.0)).items()} == {1: 1, 2: 1}
    assert ann.nearest(df.limit(0), df, k=5).count() == 0


def test_codes_are_nearest_in_each_subspace():
    x = np.random.default_rng(0).normal(size=(3000, 64))
    index = ann.train(x, 8, 20)
    near, codes = ann.encode(x[:50], index)
    for i in range(50):
        assert near[i] == np.argmin(((index.centroids - x[i]) ** 2).sum(1))
        r = x[i] - index.centroids[near[i]]
        for m, book in enumerate(index.books):
            part = r[index.cuts[m] : index.cuts[m + 1]]
            assert np.isclose(((book[codes[i, m]] - part) ** 2).sum(), ((book - part) ** 2).sum(1).min())


@pytest.mark.parametrize("spread", [1e-6, 1e-2])
def test_near_copies_that_share_their_codes(spread):
    """A tight cluster outside the sample: its entries' rough scores are equal, their true scores are not."""
    r = np.random.default_rng(5)
    index = ann.train(r.normal(size=(4000, 32)), 8, 20)
    near = r.normal(size=32) + spread * r.normal(size=(3000, 32))
    number, codes = ann.encode(near, index)
    of = number == np.bincount(number).argmax()
    x, codes, asked = near[of], codes[of], near[:300] + spread * r.normal(size=(300, 32))
    ids = r.permutation(len(x))
    rows, found, scores = ann.scan(index, int(np.bincount(number).argmax()), asked, ids, x, codes, 21)
    exact = asked @ x.T
    for q in range(len(asked)):
        best = np.lexsort((ids, -exact[q]))[:21]
        assert found[rows == q].tolist() == ids[best].tolist() and np.allclose(scores[rows == q], exact[q, best], rtol=0, atol=1e-10)


def test_short_lists_are_made_up_for(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    got = answers(ann.nearest(df, df, k=40, target=0.0))
    assert len(got) == 60 and all(len(v) == 40 for v in got.values())


def test_queries_in_small_clusters_get_all_their_neighbours(spark):
    """Six clusters of 200 and two of 6: the lists first visited may hold fewer than k; every answer is exact but a few."""
    r = np.random.default_rng(11)
    centers = 10 * r.normal(size=(8, 12))
    rows = [(i, (centers[c] + 0.1 * r.normal(size=12)).tolist()) for i, c in enumerate(np.repeat(np.arange(8), [200] * 6 + [6] * 2).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.nearest(df, df, k=20))
    want = exact(rows, rows, 20)
    assert len(got) == len(rows) and all([f[0] for f in v] == list(range(1, 21)) for v in got.values())
    hits = [len({f[1] for f in got[q]} & {w[0] for w in want[q]}) / 20 for q in got]
    assert np.mean(hits) > 0.95


def test_tables_decide_what_is_measured(monkeypatch):
    """Vectors without clusters, more than the sample: few lists' entries are measured, and few neighbours are lost."""
    r = np.random.default_rng(8)
    x = r.normal(size=(12_000, 64))
    index = ann.train(x[:6000], 24, 20)
    near, codes = ann.encode(x, index)
    assert index.probes < len(index.centroids) and 0 < index.spread < 0.6
    asked = x[:200]
    visited = np.argsort(-(asked @ index.centroids.T), axis=1)[:, : index.probes]
    measured, entries, found = 0, 0, [[] for _ in asked]
    flat = np.nonzero

    def counted(a):
        nonlocal measured
        out = flat(a)
        measured += len(out[0]) if np.ndim(a) == 2 else 0
        return out

    for number in range(len(index.centroids)):
        who, held = flat((visited == number).any(1))[0], flat(near == number)[0]
        entries += len(who) * len(held)
        with monkeypatch.context() as m:
            m.setattr(ann.np, "nonzero", counted)
            q, ids, scores = ann.scan(index, number, asked[who], held, x[held], codes[held], 21)
        for i, j, s in zip(who[q], ids, scores, strict=True):
            found[i].append((-s, j))
    exact = asked @ x.T
    hits = [len({j for _, j in sorted(f)[:21]} & set(np.argsort(-exact[i])[:21].tolist())) for i, f in enumerate(found)]
    assert np.mean(hits) / 21 > 0.95 and measured < 0.2 * entries


def test_vectors_beyond_single_precision():
    r = np.random.default_rng(9)
    x = 1e30 * r.normal(size=(2000, 16))
    index = ann.train(x, 4, 20)
    near, codes = ann.encode(x, index)
    held = np.flatnonzero(near == 0)
    rows, found, _ = ann.scan(index, 0, x[:5], held, x[held], codes[held], 10)
    for q in range(5):
        assert found[rows == q].tolist() == held[np.argsort(-(x[held] @ x[q]))[:10]].tolist()


@pytest.mark.parametrize("held", [1, 40, 10**6])
def test_blocks_of_a_task_are_merged(spark, monkeypatch, held):
    """However many rows a task may gather, the answers are the same."""
    monkeypatch.setattr(ann, "HELD", held)
    monkeypatch.setattr(ann, "BLOCK", 16)
    r = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 6)).round(1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.nearest(df, df.where("vec_id % 7 = 0"), k=5, target=1.0))
    want = exact(rows, [x for x in rows if x[0] % 7 == 0], 5)
    assert {q: [f[1] for f in found] for q, found in got.items()} == {q: [w[0] for w in v] for q, v in want.items()}
