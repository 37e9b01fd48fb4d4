"""Main text of web pages: a bidirectional LSTM labels every leaf block of a page.

A page is a sequence of blocks; one LSTM reads their vectors from the first to the last and
another from the last to the first, so that each block is judged with the whole page before and
behind it. The text of the blocks labelled main, in page order, is the result. The labeller is
trained on generated pages (``PAGES`` of them; about ten seconds), once for a shared folder: its
weights are kept there, under a name that the settings and the generator determine.

Defined results: null, empty and textless pages give an empty text; rows that repeat are each
extracted; nothing is cut, however long: both LSTMs carry their states from one run of ``CHUNK``
blocks to the next, so that labels don't depend on it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import inspect
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import html_blocks, html_training
from cardloom.llm.common import bounded_batches, exists, open_file, put_file, shared_dir, slices
from cardloom.llm.html_blocks import FEATURES, Block, blocks, vectors

HIDDEN = 24
PAGES, PASSES, BATCH = 2000, 5, 16
CHUNK = 2000
Weights = dict[str, np.ndarray]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


State = tuple[np.ndarray, np.ndarray]


def _lstm(x: np.ndarray, u: np.ndarray, mask: np.ndarray, state: State | None = None, keep: bool = True) -> tuple[np.ndarray, list[tuple], State]:
    """States of a layer whose inputs (time, page, 4 * hidden) are already projected, what its gradients need, and the last state."""
    steps, n, _ = x.shape
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = x[t] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        m = mask[t][:, None]
        if keep:
            kept.append((h, c, i, f, o, g, tc, m))
        c = m * c_new + (1 - m) * c
        h = m * o * tc + (1 - m) * h
        out[t] = h
    return out, kept, (h, c)


def _lstm_back(dout: np.ndarray, u: np.ndarray, kept: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, n, _ = dout.shape
    dx, du = np.empty((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = kept[t]
        dh = dh + dout[t]
        do, dcn = dh * m * tc, dc * m + dh * m * o * (1 - tc * tc)
        dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
        dx[t] = dz
        du += h.T @ dz
        dh = dz @ u.T + dh * (1 - m)
        dc = dcn * f + dc * (1 - m)
    return dx, du


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in parts)
    x, mask = np.zeros((steps, len(parts), FEATURES), np.float32), np.zeros((steps, len(parts)), np.float32)
    for k, p in enumerate(parts):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _forward(w: Weights, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    steps, n, _ = x.shape
    flat = x.reshape(steps * n, -1)
    a, ka, _ = _lstm((flat @ w["Wf"] + w["bf"]).reshape(steps, n, -1), w["Uf"], mask)
    b, kb, _ = _lstm((flat @ w["Wb"] + w["bb"]).reshape(steps, n, -1)[::-1], w["Ub"], mask[::-1])
    h = np.concatenate([a, b[::-1]], axis=2)
    return _sigmoid(h @ w["c"] + x @ w["s"] + w["d"]), (flat, ka, kb, h)


def _gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> Weights:
    steps, n, _ = x.shape
    p, (flat, ka, kb, h) = _forward(w, x, mask)
    dz = ((p - y) * mask / mask.sum()).astype(np.float32)
    dh = dz[:, :, None] * w["c"]
    dxa, dua = _lstm_back(dh[:, :, :HIDDEN], w["Uf"], ka)
    dxb, dub = _lstm_back(dh[::-1, :, HIDDEN:], w["Ub"], kb)
    dxa, dxb = dxa.reshape(steps * n, -1), dxb[::-1].reshape(steps * n, -1)
    return {
        "Wf": flat.T @ dxa, "bf": dxa.sum(0), "Uf": dua, "Wb": flat.T @ dxb, "bb": dxb.sum(0), "Ub": dub,
        "c": np.einsum("tn,tnh->h", dz, h), "s": flat.T @ dz.ravel(), "d": dz.sum(keepdims=True).reshape(1),
    }


def examples(seeds: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of the blocks of generated pages."""
    xs, ys = [], []
    for seed in seeds:
        found = blocks(html_training.page(seed))
        if not found:
            continue
        ys.append(np.array([html_training.MARK in b.text for b in found], dtype=np.float32))
        for b in found:
            b.text = b.text.replace(html_training.MARK, "") or "."
        xs.append(vectors([found]))
    return xs, ys


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, passes: int = PASSES, rate: float = 0.006) -> Weights:
    """The labeller's weights; the same in every session."""
    xs, ys = examples(range(pages))
    r = np.random.default_rng(5)
    w: Weights = {"c": r.normal(0, 0.2, 2 * HIDDEN), "s": np.zeros(FEATURES), "d": np.zeros(1)}
    for side in "fb":
        w["W" + side] = r.normal(0, 0.08, (FEATURES, 4 * HIDDEN))
        w["U" + side] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w["b" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    by_length = np.argsort([len(x) for x in xs], kind="stable")
    batches = [by_length[i : i + BATCH] for i in range(0, len(by_length), BATCH)]
    step, last = 0, passes * len(batches)
    for _ in range(passes):
        for k in r.permutation(len(batches)):
            x, mask = _padded([xs[i] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(ys[i]), j] = ys[i]
            step += 1
            for name, g in _gradients(w, x, mask, y).items():
                g = np.clip(g + 1e-5 * w[name], -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.995 * v[name] + 0.005 * g * g
                speed = rate * (1 - 0.9 * step / last)
                w[name] -= (speed * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return w


def weights(spark: SparkSession) -> Weights:
    """The labeller's weights from the shared folder, where they are put if they are not there."""
    about = "".join(inspect.getsource(m) for m in (html_training, html_blocks)) + repr((PAGES, PASSES, BATCH, HIDDEN, inspect.getsource(trained)))
    place = f"{shared_dir(spark)}/html-labeller-{hashlib.sha1(about.encode()).hexdigest()}.npz"
    if not exists(place):
        data = io.BytesIO()
        np.savez(data, **trained())
        put_file(place, iter([data.getvalue()]))
    with open_file(place) as f, np.load(io.BytesIO(f.read())) as held:
        return dict(held)


def _carried(x: np.ndarray, w: np.ndarray, b: np.ndarray, u: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The states of a layer, with its inputs projected a chunk at a time."""
    out, state = np.empty((*mask.shape, HIDDEN), np.float32), None
    for lo in range(0, len(x), CHUNK):
        p = slice(lo, lo + CHUNK)
        out[p], _, state = _lstm(x[p] @ w + b, u, mask[p], state, keep=False)
    return out


def label(w: Weights, parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each page the probability of each of its blocks to be main text."""
    out = [np.zeros(len(p), np.float32) for p in parts]
    order = sorted((k for k, p in enumerate(parts) if len(p)), key=lambda k: len(parts[k]))
    at = 0
    while at < len(order):
        n = max(1, min(64, 20_000 // len(parts[order[min(at + 63, len(order) - 1)]])))
        some = order[at : at + n]
        at += n
        x, mask = _padded([parts[k] for k in some])
        ahead = _carried(x, w["Wf"], w["bf"], w["Uf"], mask)
        back = _carried(x[::-1], w["Wb"], w["bb"], w["Ub"], mask[::-1])[::-1]
        p = _sigmoid(ahead @ w["c"][:HIDDEN] + back @ w["c"][HIDDEN:] + x @ w["s"] + w["d"])
        for j, k in enumerate(some):
            out[k] = p[: len(parts[k]), j]
    return out


def main_text(found: list[Block], main: np.ndarray) -> str:
    return "\n".join(b.text for b, keep in zip(found, main, strict=True) if keep)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``url`` and the main ``text``, with the numbers of blocks and of those kept."""
    bounded_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(weights(pages.sparkSession))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 2 << 20):
                found = [blocks(h) if h else [] for h in batch.column("html").to_pylist()]
                x = vectors(found)
                at = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(int)
                kept = [p >= threshold for p in label(held.value, [x[a:b] for a, b in zip(at, at[1:], strict=False)])]
                text = [main_text(f, k) for f, k in zip(found, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array([int(k.sum()) for k in kept], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_kept"],
                )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_blocks bigint, n_kept bigint")
