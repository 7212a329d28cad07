"""Language identification by a bidirectional gated recurrent network over bytes.

Each text is cut into windows of ``WINDOW`` bytes; two small gated recurrent cells read every
window forwards and backwards, a softmax labels every byte position, and a document's score
is the mean of the label probabilities over all its positions. Gates are piecewise linear
(clipped), so a step is a few array operations over thousands of windows at once. The model
is trained in numpy by backpropagation through time on a bounded sample of labelled rows.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
labelled row every text is ``und``; with one label every text with a letter gets it; texts
are read whole; rows with equal doc_id are separate rows; null doc_ids stay null and aren't held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, id_again, id_text

#: Labelled rows that the model is fitted on at most, over all labels, and characters of each, from a place its hash picks.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 1000
HIDDEN, WINDOW = 8, 128
#: Windows that run side by side.
LANES = 4096


@dataclass
class Model:
    labels: list[str]
    cells: list[dict[str, np.ndarray]]
    out: np.ndarray
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def _start(labels: list[str], seed: int) -> Model:
    rng, h = np.random.default_rng(seed), HIDDEN
    cell = lambda: {"x": rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32), "u": rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)}
    return Model(labels, [cell(), cell()], rng.normal(0, 0.3, (2 * h, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))


def _forward(cell: dict, seq: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step of ``seq`` (steps, lanes), and what the backward pass needs."""
    h, kept, states = np.zeros((seq.shape[1], HIDDEN), np.float32), [], []
    for ids in seq:
        x, uh = cell["x"][ids], h @ cell["u"]
        z, r = _gate(x[:, :HIDDEN] + uh[:, :HIDDEN]), _gate(x[:, HIDDEN : 2 * HIDDEN] + uh[:, HIDDEN : 2 * HIDDEN])
        uc = uh[:, 2 * HIDDEN :]
        c = np.clip(x[:, 2 * HIDDEN :] + r * uc, -1, 1)
        kept.append((h, z, r, uc, c))
        h = h + z * (c - h)
        states.append(h)
    return np.stack(states), kept


def _backward(cell: dict, seq: np.ndarray, kept: list, dstates: np.ndarray) -> dict:
    """Gradients of a cell by backpropagation through time."""
    grad = {k: np.zeros_like(v) for k, v in cell.items()}
    dh = np.zeros_like(dstates[0])
    for t in range(len(seq) - 1, -1, -1):
        h, z, r, uc, c = kept[t]
        d = dstates[t] + dh
        dc = d * z * ((c > -1) & (c < 1))
        dz = d * (c - h) * 0.25 * ((z > 0) & (z < 1))
        dr = dc * uc * 0.25 * ((r > 0) & (r < 1))
        dx = np.concatenate([dz, dr, dc], 1)
        du = np.concatenate([dz, dr, dc * r], 1)
        np.add.at(grad["x"], seq[t], dx)
        grad["u"] += h.T @ du
        dh = d * (1 - z) + du @ cell["u"].T
    return grad


def train(texts: list[bytes], labels: list[str], steps: int = 220, lanes: int = 192, length: int = 48, seed: int = 7) -> Model:
    """Adam on the mean cross-entropy of all positions of random windows, labels drawn evenly."""
    names = sorted(set(labels))
    model = _start(names, seed)
    if len(names) < 2:
        return model
    rng = np.random.default_rng(seed + 1)
    by = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == n and t] for n in names]
    params = [model.cells[0]["x"], model.cells[0]["u"], model.cells[1]["x"], model.cells[1]["u"], model.out, model.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    usable = [i for i, b in enumerate(by) if b]
    for step in range(1, steps + 1):
        y = np.resize(usable, lanes)
        seq = np.full((length, lanes), 256, np.int64)
        for lane, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            a = rng.integers(max(1, len(t) - length + 1))
            w = t[a : a + length]
            seq[: len(w), lane] = w
        fs, fk = _forward(model.cells[0], seq)
        bs, bk = _forward(model.cells[1], seq[::-1])
        states = np.concatenate([fs, bs[::-1]], 2)
        logits = states @ model.out + model.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(lanes), y] -= 1
        d = (p * (seq < 256)[:, :, None] / max(1, int((seq < 256).sum()))).astype(np.float32)
        ds = d @ model.out.T
        g0, g1 = _backward(model.cells[0], seq, fk, ds[:, :, :HIDDEN]), _backward(model.cells[1], seq[::-1], bk, ds[::-1, :, HIDDEN:])
        grads = [g0["x"], g0["u"], g1["x"], g1["u"], np.tensordot(states, d, ([0, 1], [0, 1])), d.sum((0, 1))]
        rate = 0.02 * min(1, 3 * (1 - step / (steps + 1)))
        for i, (q, g) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            q -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


class Reader:
    """Labels every byte of many windows at once; the working arrays are kept between calls."""

    def __init__(self, model: Model):
        h = HIDDEN
        self.k = len(model.labels)
        self.cells = []
        for c in model.cells:
            scale = np.r_[np.full(2 * h, 0.25), np.ones(h)].astype(np.float32)
            x, u = c["x"] * scale, c["u"] * scale
            x[:, : 2 * h] += 0.5
            self.cells.append(([np.ascontiguousarray(x[:, i * h : (i + 1) * h]) for i in range(3)], [np.ascontiguousarray(u[:, i * h : (i + 1) * h]) for i in range(3)]))
        self.out, self.bias = [np.ascontiguousarray(model.out[i * h : (i + 1) * h]) for i in range(2)], model.bias

    def _read(self, cell, seq: np.ndarray, order: range, states: np.ndarray) -> None:
        (xz, xr, xc), (uz, ur, uc) = cell
        n = seq.shape[1]
        h, z, r, c, t = (np.zeros((n, HIDDEN), np.float32) for _ in range(5))
        for i in order:
            ids = seq[i]
            np.matmul(h, uz, out=z)
            np.take(xz, ids, axis=0, out=t, mode="clip")
            z += t
            np.clip(z, 0, 1, out=z)
            np.matmul(h, ur, out=r)
            np.take(xr, ids, axis=0, out=t, mode="clip")
            r += t
            np.clip(r, 0, 1, out=r)
            np.matmul(h, uc, out=c)
            c *= r
            np.take(xc, ids, axis=0, out=t, mode="clip")
            c += t
            np.clip(c, -1, 1, out=c)
            c -= h
            c *= z
            h += c
            states[i] = h

    def label(self, windows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the label probabilities over each window's ``size`` positions. windows: (lanes, steps), padded with 256."""
        seq = np.ascontiguousarray(windows.T).astype(np.intp)
        steps, n = seq.shape
        states = np.empty((steps, n, HIDDEN), np.float32)
        self._read(self.cells[0], seq, range(steps), states)
        logits = states.reshape(-1, HIDDEN) @ self.out[0]
        self._read(self.cells[1], seq, range(steps - 1, -1, -1), states)
        logits += states.reshape(-1, HIDDEN) @ self.out[1]
        logits += self.bias
        np.clip(logits, -30, 30, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        logits = logits.reshape(steps, n, self.k)
        logits *= (np.arange(steps)[:, None] < size[None])[:, :, None]
        return logits.sum(0)


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all byte positions of each text (zeros for an empty one)."""
    reader, k = Reader(model), len(model.labels)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    total = np.zeros((len(texts), k))
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.repeat(np.cumsum(size) - size, count) + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    left = np.repeat(np.cumsum(size), count) - begin
    length = np.minimum(left, WINDOW)
    # windows of like length run together, so that few steps are padding
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), LANES):
        at = order[a : a + LANES]
        steps = int(length[at].max())
        where = begin[at][:, None] + np.arange(steps)
        w = np.where(np.arange(steps) < length[at][:, None], flat[np.minimum(where, len(flat) - 1)], np.int16(256))
        sums = reader.label(w, length[at])
        for j in range(k):
            total[:, j] += np.bincount(owner[at], sums[:, j], len(texts))
    return total / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _slice(text: Column, h: Column) -> Column:
    return F.substring(text, F.lit(1) + F.pmod(h, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))).cast("int"), F.lit(SAMPLE_CHARS))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits a model on at most ``rows`` labelled rows that are not held out, the same share of rows for each label's hash order.

    Every label is learnt; more labels than ``rows`` are an error, as some would have no row to learn from.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows + 1).collect()}
    labels = list(counts)
    if len(labels) > rows:
        raise ValueError(f"more than {rows} labels, the rows to learn from")
    if not labels:
        return None
    each = max(1, rows // len(labels))
    # rows of the smallest hashes: a bound that about three times as many pass keeps tasks from sending more
    bounds = [(lang, min(2**63 - 1, int(-(2**63) + 2**64 * 3 * each / counts[lang]))) for lang in labels]
    most = F.broadcast(docs.sparkSession.createDataFrame(bounds, "label string, most long"))
    sample = usable.select("lang", "text", F.xxhash64("doc_id").alias("h")).join(most, F.col("lang") == F.col("label")).where("h <= most")
    sample = sample.select("lang", _slice(F.col("text"), F.col("h")).alias("t"), "h")
    first = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("place") <= each)
    got = sorted(first.collect(), key=lambda r: (labels.index(r["lang"]), r["place"]))
    return train([r["t"].encode() for r in got], [r["lang"] for r in got]) if got else None


def predict(model: Model | None, texts: pd.Series, lettered: pd.Series) -> pd.DataFrame:
    """``lang_pred, score`` of each text."""
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if model is not None and len(texts):
        ok = lettered.to_numpy(bool)
        p = pooled(model, [(t or "").encode() if good else b"" for t, good in zip(texts, ok, strict=True)])
        best = p.argmax(1)
        pred = [model.labels[b] if good else "und" for b, good in zip(best, ok, strict=True)]
        score = np.where(ok, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
    return pd.DataFrame({"lang_pred": pred, "score": score})


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; one narrow pass."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[["doc_id", "held_out"]], predict(model, pdf["text"], pdf["lettered"])], axis=1)

    rows = docs.select(id_text(), held_out(F.col("doc_id")).alias("held_out"), _lettered().alias("lettered"), F.col("text"))
    return id_again(rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"))


def keep_identified(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs`` with a language of a score of ``least`` or more; all columns as they are."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series, lettered: pd.Series) -> pd.DataFrame:
        return predict(model, texts, lettered)

    found = label(F.col("text"), _lettered())
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= least))
