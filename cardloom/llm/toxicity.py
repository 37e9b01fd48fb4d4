"""Toxicity by compression distance.

Two zstandard dictionaries are trained on the labelled texts of either class. The ordinary one
has pieces of all ordinary texts. The toxic one has what toxic texts differ in, the single words
(or their beginnings) that have far more different neighbours in toxic than in ordinary texts, in
line, and behind them the ordinary content, so that the two differ in nothing else. At most
``SAMPLES`` pieces train either. (Trained on all text of its class alone, the toxic dictionary holds what is common
to both, and tells them badly: README has the figures.) Each text is cut into overlapping windows;
a window is compressed with either dictionary, and the bytes that the toxic one saves are its
distance. Thresholds on that distance are calibrated on ordinary windows, and a logistic
curve, fitted on labelled texts that took no part in the dictionaries, turns a text's windows
into a score.

Fitting reads at most ``max_per_class`` labelled texts of each class (chosen by a hash of the
id, and one text of an id that repeats) and ``max_bytes`` of them; scoring reads every window of
every text. Defined results: null and empty texts have one empty window and get the score of a
text without toxic windows; without labels of both classes the score is the share of toxic labels
(0 without any); rows that repeat are each scored; a document labelled twice counts as toxic if
any label says so. A to Z count as a to z.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm import bytewords
from cardloom.llm.bytewords import LOWER
from cardloom.llm.common import bounded_batches, labelled_texts, slices, text_buffer

WINDOW, STEP = 48, 36
LEVEL = 9
ORDINARY_BYTES, TOXIC_BYTES = 40_000, 4096
MAX_PER_CLASS, MAX_BYTES = {1: 2000, 0: 4000}, 64 << 20
#: Most samples that a dictionary is trained on, drawn evenly from all of them.
SAMPLES = 60_000
FEATURES = 17
STEMS = (4, 6)
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCORE = "score double, n_windows bigint, n_toxic bigint, most_saved bigint"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int  # bytes saved from which a window is toxic
    weights: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def _lengths(c: zstandard.ZstdCompressor, windows: zstandard.BufferWithSegments, n: int) -> np.ndarray:
    out = c.multi_compress_to_buffer(windows, threads=1)
    return np.fromiter((len(out[i]) for i in range(n)), np.int64, n)


def saved(raw: np.ndarray, offsets: np.ndarray, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[np.ndarray, np.ndarray]:
    """(text, bytes that the toxic dictionary saves) of every window of texts that lie one after the other."""
    size = np.diff(offsets)
    number = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(size)), number)
    at = np.repeat(offsets[:-1], number) + (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STEP
    length = np.minimum(WINDOW, offsets[1:][text] - at)
    if not len(at):
        return text, np.zeros(0, np.int64)
    segments = np.stack([at, length], axis=1).astype("<u8").tobytes()
    windows = zstandard.BufferWithSegments(raw.tobytes(), segments)
    return text, _lengths(ordinary, windows, len(at)) - _lengths(toxic, windows, len(at))


def _features(text: np.ndarray, gain: np.ndarray, n: int, threshold: int) -> np.ndarray:
    """Of each text: the most saved, and how many and what share of its windows save how much."""
    most = np.zeros(n)
    np.maximum.at(most, text, gain)
    windows = np.bincount(text, minlength=n)
    counts = [np.log1p(np.bincount(text, gain >= k, n)) for k in range(1, 8)]
    rates = [np.sqrt(np.bincount(text, gain >= k, n) / np.maximum(windows, 1)) for k in range(1, 8)]
    hits = np.bincount(text, gain >= threshold, n)
    return np.stack([np.minimum(most, 12), *counts, *rates, hits / np.maximum(windows, 1), np.log1p(windows)], axis=1)


def _contexts(texts: list[str]) -> Counter:
    """How many different neighbourhoods (a word before, a word behind) each word has; copies of a text add nothing."""
    seen, owners = [], []
    spelled: dict[int, str] = {}
    for part in slices(pa.record_batch([pa.array(texts, pa.string())], names=["text"]), "text", 1 << 20):
        w = bytewords.words(part.column("text"))
        h = np.concatenate(([0], w.hash, [0])).astype(np.uint64)
        of = np.concatenate(([-1], w.text_of(), [-1]))
        before, behind = h[:-2] * (of[:-2] == of[1:-1]), h[2:] * (of[2:] == of[1:-1])
        seen.append(bytewords.mix(before * bytewords.PLACES[0] + h[1:-1] * bytewords.PLACES[1] + behind * bytewords.PLACES[2]))
        owners.append(w.hash)
        for key, k in zip(*np.unique(w.hash, return_index=True), strict=True):
            if int(key) not in spelled:
                spelled[int(key)] = w.bytes_at(int(k), 1).decode()
    if not seen:
        return Counter()
    _, first = np.unique(np.concatenate(seen), return_index=True)
    words, count = np.unique(np.concatenate(owners)[first], return_counts=True)
    return Counter({spelled[int(k)]: int(n) for k, n in zip(words, count, strict=True)})


def _with_stems(words: Counter) -> Counter:
    """The counts of words, and of their first few letters."""
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "-"] += n
    return out


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    plain = b"".join(t.encode() for t in ordinary)
    base = _trained([plain[i : i + 256] for i in range(0, len(plain), 256)], ORDINARY_BYTES, 64)
    here, there = _contexts(toxic), _contexts(ordinary)
    share = sum(here.values()) / max(1, sum(there.values()))
    here, there = _with_stems(here), _with_stems(there)
    expected = {w: share * (there[w] + 1) for w in here}
    telling = {w for w, k in here.items() if k >= max(4 * expected[w], expected[w] + 5 * math.sqrt(expected[w]) + 3)}
    parts = [f" {m} ".encode() for t in toxic for m in _WORD.findall(t) if m in telling or any(m[:k] + "-" in telling for k in STEMS)]
    # the same few passages often, in another order each time, as training wants many samples
    order = np.random.default_rng(7).permutation(len(parts)) if parts else []
    samples = [b"".join(parts[k] for k in order[i : i + 16]) for i in range(0, len(order), 16)]
    return base, _trained(samples, TOXIC_BYTES, 24) + base


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """Content that zstandard picks from the samples; the last of these themselves where it finds them too few to train on."""
    if len(samples) > SAMPLES:
        samples = [samples[k] for k in np.sort(np.random.default_rng(3).choice(len(samples), SAMPLES, replace=False))]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6 if k < 64 else 8, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(rows: list[tuple[int, str | None, int]]) -> Model:
    """The model for labelled (id, text, toxic) rows."""
    # A to Z only, as in scoring
    rows = sorted(((i, (t or "").encode().lower().decode(), y) for i, t, y in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    y = np.array([r[2] for r in rows], dtype=float)
    rate = float(y.mean()) if len(y) else 0.0
    flat = (np.zeros(FEATURES), np.ones(FEATURES))
    if rate in (0.0, 1.0):
        base = {0.0: -60.0, 1.0: 60.0}[rate]
        return Model(b"", b"", 1, np.array([0.0] * FEATURES + [base]), flat)
    for_words = np.arange(len(rows)) % 4 < 3
    base, extra = _dictionaries([r[1] for r, d in zip(rows, for_words, strict=True) if d and r[2]], [r[1] for r, d in zip(rows, for_words, strict=True) if d and not r[2]])
    rest = ~for_words if y[~for_words].sum() >= 20 else np.ones(len(rows), dtype=bool)
    held = [r for r, d in zip(rows, rest, strict=True) if d]
    raw, offsets = text_buffer(pa.array([r[1] for r in held], pa.string()))
    text, gain = saved(LOWER[raw], offsets, _compressor(base), _compressor(extra))
    plain = gain[y[rest][text] == 0]
    threshold = next((k for k in range(1, 20) if (plain >= k).mean() <= 0.001), 20) if len(plain) else 3
    x = _features(text, gain, len(held), threshold)
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(FEATURES + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y[rest]) + 0.5 * np.append(w[:-1], 0)
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(FEATURES + 1), grad)
    return Model(base, extra, threshold, w, (mean, deviation))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: dict[int, int] | None = None, max_bytes: int = MAX_BYTES) -> Model:
    """Train on a sample of the labelled texts, of a size that doesn't grow with the tables."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    return train(labelled_texts(docs, marks, max_per_class or MAX_PER_CLASS, max_bytes, id_col, text_col))


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the score of each text, with its number of windows, of toxic ones, and the most bytes saved."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        ordinary, toxic = _compressor(m.ordinary), _compressor(m.toxic)
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                score, text, gain = _scores(batch.column("text"), m, ordinary, toxic)
                most = np.zeros(n, dtype=np.int64)
                np.maximum.at(most, text, gain)
                hits = np.bincount(text, gain >= m.threshold, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(score), pa.array(np.bincount(text, minlength=n)), pa.array(hits), pa.array(most)],
                    names=["doc_id", "score", "n_windows", "n_toxic", "most_saved"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCORE}")


def _scores(column: pa.Array, m: Model, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, text of each window, bytes saved in each window)."""
    raw, offsets = text_buffer(column)
    text, gain = saved(LOWER[raw], offsets, ordinary, toxic)
    x = (_features(text, gain, len(column), m.threshold) - m.scale[0]) / m.scale[1]
    return 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30))), text, gain


def filter_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``limit``."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        ordinary, toxic = _compressor(m.ordinary), _compressor(m.toxic)
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(_scores(batch.column(text_col), m, ordinary, toxic)[0] < limit))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` when divided by ``folds``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
