import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from cardloom.llm import common, quality, queries, toxicity
from cardloom.llm.bytewords import LOWER
from cardloom.llm.common import text_buffer

SF = "/root/testdata/sf0.1"
EDGES = [(1, None), (2, ""), (3, "a"), (4, "word " * 60_000), (5, "same"), (5, "same"), (None, "x y z"), (6, "é" * 5000)]


def area(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / y.sum() / (len(y) - y.sum())


@pytest.mark.parametrize(
    "query, label, folds, fold, limit, least, good",
    [(queries.op2_toxicity, "toxic", 5, 0, 0.5, 0.93, 0.95), (queries.op3_quality, "quality", 4, 2, 0.7, 0.98, 0.97)],
)
def test_held_out_documents(spark, query, label, folds, fold, limit, least, good):
    got = query(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    crc = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds)
    assert (got.held_out == (crc == fold)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= limit)).all()
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    seen = got[got.held_out].merge(truth, on="doc_id")
    assert area(seen.score.to_numpy(), seen[label].to_numpy()) > least
    assert (seen.predicted == seen[label]).mean() > good


@pytest.mark.parametrize("module, run", [(toxicity, toxicity.score_toxicity), (quality, quality.score_quality)])
def test_odd_texts_and_labels(spark, module, run):
    name = "toxic" if module is toxicity else "quality"
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in EDGES], "doc_id long, text string, score double, label int")
    for marks in ([], [(1, 1)], [(4, 0), (6, 1), (3, None), (None, 1), (3, 0), (3, 1)]):
        model = module.fit(docs, spark.createDataFrame(marks, f"doc_id long, {name} int"))
        got = run(docs, model).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in EDGES)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert run(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    """Repeated ids give one text, labels a bounded number of ids each, and texts a bounded number of bytes."""
    docs = spark.createDataFrame([*((1, f"copy {k}") for k in range(500)), *((i, "x" * 1000) for i in range(2, 40)), (50, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    rows = common.labelled_texts(docs, marks, {1: 10, 0: 7}, 1 << 20, "doc_id", "text")
    assert len({r[0] for r in rows}) == len(rows) <= 17 and sum(r[2] for r in rows) <= 10
    rows = common.labelled_texts(docs, marks, 60, 5000, "doc_id", "text")
    assert 0 < sum(len(r[1] or "") for r in rows) <= 5000 and all(r[1] in (None, "copy 0", "x" * 1000) for r in rows)
    assert common.labelled_texts(docs.limit(0), marks, 60, 5000, "doc_id", "text") == []


def test_samples_of_a_dictionary_come_from_everywhere(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLES", 400)
    seen = []
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples, **how: seen.extend(samples) or (_ for _ in ()).throw(zstandard.ZstdError("too few")))
    held = toxicity._trained([b"first"] * 5000 + [b"second"] * 5000, 50, 24)
    assert len(seen) == 400 and 120 < seen.count(b"first") < 280 and len(held) == 50


def test_windows_cover_every_byte():
    texts = ["", "ab", "c" * 48, "d" * 49, "e" * 1000]
    raw, offsets = text_buffer(pa.array(texts))
    same = toxicity._compressor(b"c" * 300 + b"e" * 300)
    text, gain = toxicity.saved(LOWER[raw], offsets, same, same)
    assert (gain == 0).all() and np.bincount(text, minlength=5).tolist() == [0, 1, 1, 2, 28]


def test_attention_is_a_distribution():
    raw, offsets = text_buffer(pa.array(["", "a b c " * 500, "X!! " * 90]))
    text, x = quality.passages(raw, offsets)
    assert text.tolist() == [0, 1, 1, 1, 1, 1, 1, 2] and np.isfinite(x).all()
    model = quality.train([(i, ("good words here " if i % 2 else "BAD!! ") * 60, i % 2) for i in range(40)], passes=3)
    score, weight = model.score(text, x, 3)
    assert np.allclose(np.bincount(text, weight), 1) and score.shape == (3,)


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    w = {"W": r.normal(size=(5, 4)), "b": r.normal(size=4), "V": r.normal(size=(4, 3)), "U": r.normal(size=(4, 3)), "w": r.normal(size=3), "c": r.normal(size=4), "d": r.normal(size=1)}
    x, text, start, y = r.normal(size=(7, 5)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._forward(w, x, start, text)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = quality._gradients(w, x, start, text, y)
    for k, g in grads.items():
        at = tuple(int(n) // 2 for n in w[k].shape)
        kept, e = w[k][at], 1e-6
        w[k][at] = kept + e
        up = loss()
        w[k][at] = kept - e
        assert np.isclose((up - loss()) / 2 / e, g[at], atol=1e-6), k
        w[k][at] = kept


def test_long_texts_do_not_end_a_sample(spark):
    docs = spark.createDataFrame([(k, "x" * (5000 if k % 2 else 10)) for k in range(20)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "1 AS label")
    got = common.labelled_texts(docs, marks, 20, 1000, "doc_id", "text")
    assert sorted(r[0] for r in got) == list(range(0, 20, 2))
