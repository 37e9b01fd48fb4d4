"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` bytes. Every passage becomes a vector (pairs of
character classes, hashed words, and how its words repeat), which one hidden layer encodes.
Gated attention gives each passage of a bag its weight: a softmax over w . (tanh(V h) * sigm(U h)).
The weighted sum of the passages' codes is the text's representation, and a logistic output on
it is learned from the labels of whole texts alone.

Fitting reads at most ``max_rows`` labelled texts and ``max_bytes`` of them, chosen by a hash of
the id (one text of an id that repeats); scoring encodes every passage of every text. Defined results: null and empty texts are one empty passage;
without labels of both classes every score is the share of good labels (0.5 without any); rows
that repeat are each scored; a document labelled twice is as good as its worst label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm import bytewords
from cardloom.llm.common import bounded_batches, labelled_texts, slices, text_buffer

PASSAGE = 512
MAX_ROWS, MAX_BYTES = 6000, 64 << 20
HIDDEN, GATE = 32, 16
_WORD_BUCKETS = 64


def _classes() -> np.ndarray:
    """A class from 0 to 15 for each byte: kinds of letters, digits, spaces and symbols."""
    c = np.full(256, 15, dtype=np.int64)
    for k, group in enumerate((" ", "\n\r", "\t", ".", ",;:", "!?", "|", "*#$%&", "()[]{}<>", "\"'`", "-_/\\=+~^@")):
        for x in group:
            c[ord(x)] = k
    c[ord("0") : ord("9") + 1] = 11
    c[ord("A") : ord("Z") + 1] = 12
    c[ord("a") : ord("z") + 1] = 13
    c[0x80:] = 14
    return c


_CLASS = _classes()
FEATURES = 256 + _WORD_BUCKETS + 6


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, vector) of every passage of texts that lie one after the other."""
    size = np.diff(offsets)
    number = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(number) - number
    text = np.repeat(np.arange(len(size)), number)
    n = len(text)
    x = np.zeros((n, FEATURES), dtype=np.float32)
    if len(raw):
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
        passage = np.repeat(first, size) + place // PASSAGE
        kind = _CLASS[raw]
        pair = kind[:-1] * 16 + kind[1:]
        same = passage[:-1] == passage[1:]
        pairs = np.bincount(passage[:-1][same] * 256 + pair[same], minlength=n * 256).reshape(n, 256)
        x[:, :256] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
        w = bytewords.words_of(raw, offsets)
        if len(w.hash):
            of = passage[w.start]
            words = np.maximum(1, np.bincount(of, minlength=n)).astype(np.float64)
            bucket = (w.hash >> np.uint64(58)).astype(np.int64)
            x[:, 256 : 256 + _WORD_BUCKETS] = np.sqrt(np.bincount(of * _WORD_BUCKETS + bucket, minlength=n * _WORD_BUCKETS).reshape(n, -1) / words[:, None])
            fine = (w.hash >> np.uint64(54)).astype(np.int64)
            key, times = np.unique(of * 1024 + fine, return_counts=True)
            x[:, -6] = np.bincount(key // 1024, times.astype(np.float64) ** 2, n) / words**2
            again = np.zeros(len(w.hash))
            again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
            x[:, -5] = np.bincount(of, again, n) / words
            x[:, -4] = np.bincount(of, w.end - w.start, n) / words / 10
            x[:, -3] = np.log1p(words) / 5
        x[:, -2] = np.log1p(np.repeat(number, number)) / 3
        x[:, -1] = np.log1p(np.repeat(size, number)) / 8
    return text, x


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def score(self, text: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text, attention weight of each passage)."""
        if self.constant is not None:
            return np.full(n, self.constant), 1 / np.bincount(text, minlength=n)[text]
        p, a = _forward(self.weights, (x - self.mean) / self.deviation, np.searchsorted(text, np.arange(n)), text)[:2]
        return p.astype(np.float64), a


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (t * g) @ w["w"]
    e = np.exp(s - np.maximum.reduceat(s, start)[text])
    a = e / np.add.reduceat(e, start)[text]
    z = np.add.reduceat(h * a[:, None], start, axis=0)
    return _sigmoid(z @ w["c"] + w["d"]), a, h, t, g, z


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, a, h, t, g, z = _forward(w, x, start, text)
    dz = (p - y) / len(y)
    dbag = dz[:, None] * w["c"]
    dh = a[:, None] * dbag[text]
    da = (h * dbag[text]).sum(1)
    ds = a * (da - np.add.reduceat(a * da, start)[text])
    dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
    dh += dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dz, "d": dz.sum(keepdims=True)}


def train(rows: list[tuple[int, str | None, int]], *, passes: int = 12, rate: float = 0.004, decay: float = 1e-4, batch: int = 128) -> Model:
    """The model for labelled (id, text, quality) rows, by Adam over batches of texts."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    y = np.array([r[2] for r in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), constant=float(y.mean()) if len(y) else 0.5)
    texts = pa.record_batch([pa.array([r[1] for r in rows], pa.string())], names=["text"])
    parts = [passages(*text_buffer(b.column("text"))) for b in slices(texts, "text")]
    x = np.concatenate([p[1] for p in parts])
    number = np.concatenate([np.bincount(p[0]) for p in parts])
    text = np.repeat(np.arange(len(y)), number)
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = ((x - mean) / deviation).astype(np.float32)
    first = np.append(np.searchsorted(text, np.arange(len(y))), len(text))
    r = np.random.default_rng(11)
    w = {"W": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.2, (HIDDEN, GATE)), "U": r.normal(0, 0.2, (HIDDEN, GATE)), "w": r.normal(0, 0.2, GATE), "c": r.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step = 0
    for _ in range(max(passes, 2000 * passes // max(2000, len(y)))):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            count = first[bags + 1] - first[bags]
            start = np.cumsum(count) - count
            rows_in = np.repeat(first[bags] - start, count) + np.arange(count.sum())
            grads = _gradients(w, x[rows_in], start, np.repeat(np.arange(len(bags)), count), y[bags])
            step += 1
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, deviation, w)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on at most ``max_rows`` of the labelled texts, and at most ``max_bytes`` of text."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    return train(labelled_texts(docs, marks, max_rows, max_bytes, id_col, text_col))


def score_quality(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the score of each text, its number of passages, and the one that weighs most."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                text, x = passages(*text_buffer(batch.column("text")))
                n = batch.num_rows
                score, weight = held.value.score(text, x, n)
                first = np.searchsorted(text, np.arange(n))
                order = np.lexsort((-weight, text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score), pa.array(np.bincount(text, minlength=n)), pa.array(order[first] - first), pa.array(weight[order[first]].astype(np.float64))],
                    names=["doc_id", "score", "n_passages", "top_passage", "top_weight"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_passages bigint, top_passage bigint, top_weight double")
