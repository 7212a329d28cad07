"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text are densities and counts of lexicon words and word beginnings
(both learned from labelled rows by their odds), nearness of second-person words to them,
capitals, punctuation runs, disguised words and what those are when undisguised. Trees and
calibration are written in numpy and fitted on a bounded sample of labelled rows; the
features of a row come from a lexicon that was learned without that row's fold.

Defined results: null text is the empty text and gets a score too; without labelled rows,
or with one label only, every score is that label's share (0 without rows); texts are read
whole; rows with equal doc_id are separate rows; null doc_ids stay null and aren't held out;
a single row of a label is learned from without folds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, id_again, id_text, text_or_empty

#: Labelled rows of each label that the model is fitted on at most.
SAMPLE_ROWS = 2500
#: Characters of all texts of a label that the model is fitted on at most; texts are taken whole.
SAMPLE_CHARS = 20_000_000
#: Second-person words of the languages at hand.
YOU = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch tu te toi vous ton ta tes tú ti usted ustedes vosotros tus".split())
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")

_WORD = re.compile(r"[^\W_]+(?:[*@$!.\-0-9]+[^\W\d_]+)*")
_LOUD = re.compile(r"[!?]{2,}")
_BREAK = re.compile(r"[*@$!.\-0-9]")

NAMES = ["hits", "hit_rate", "starts", "start_rate", "weight", "top_weight", "near_you", "capitals", "marks", "loud", "disguised", "undisguised_hits", "size"]


@dataclass
class Lexicon:
    words: dict[str, float]
    starts: dict[str, float]


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def learn_lexicon(token_sets: list[set[str]], toxic: np.ndarray, least: int) -> Lexicon:
    """Words and beginnings of 4 to 6 letters that at least ``least`` toxic rows hold, by the log of their odds ratio."""
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]

    def weights(sets: list[set[str]]) -> dict[str, float]:
        seen = [Counter(), Counter()]
        for s, y in zip(sets, toxic, strict=True):
            seen[int(y)].update(s)
        out = {}
        for w, k in seen[1].items():
            if k >= least:
                # a standard deviation below the count, so that chance words of a few copies stay out
                ratio = np.log((k - k**0.5) / n[1]) - np.log((seen[0][w] + 0.5) / n[0])
                if ratio > 2.5:
                    out[w] = float(min(ratio, 8.0))
        return out

    starts = [{w[:k] for w in s for k in (4, 5, 6) if len(w) >= k} for s in token_sets]
    return Lexicon(weights(token_sets), weights(starts))


def features(text: str, lex: Lexicon) -> list[float]:
    words = _tokens(text)
    n = len(words) or 1
    hits, starts, weight, top, spots, disguised, undisguised = 0, 0, 0.0, 0.0, [], 0, 0
    known, begin = lex.words, lex.starts
    for w, count in Counter(words).items():
        a = known.get(w, 0.0)
        b = begin.get(w[:4], 0.0) or begin.get(w[:5], 0.0) or begin.get(w[:6], 0.0)
        if not w.isalpha() and _BREAK.search(w) and not w.isdigit():
            disguised += count
            plain = [_BREAK.sub("", w), _BREAK.sub("", w.translate(DISGUISE))]
            if c := max((known.get(p, 0.0) or begin.get(p[:4], 0.0) for p in plain), default=0.0):
                undisguised += count
                a = max(a, c)
        if a or b:
            hits += count if a else 0
            starts += count if b else 0
            weight += max(a, b) * count
            top = max(top, a, b)
            spots.append(w)
    near = 0
    if spots:
        there = {w for w in spots}
        you = np.array([i for i, w in enumerate(words) if w in YOU])
        if len(you):
            at = np.array([i for i, w in enumerate(words) if w in there])
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
            near = int((gap <= 3).sum())
    chars = len(text) or 1
    marks = text.count("!") + text.count("?")
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [hits, 100 * hits / n, starts, 100 * starts / n, weight, top, near, capitals / chars, 100 * marks / chars, len(_LOUD.findall(text)) / n, disguised / n, undisguised, float(np.log1p(n))]


@dataclass
class Trees:
    """Each tree is complete, of depth ``depth``: arrays of features, cuts and leaves."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, damp: float = 1.0, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaves and quantile histograms."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    # features that are zero almost everywhere still need a cut above zero
    cuts = [np.unique(np.r_[k, 0.0]) if (c > 0).any() else k for k, c in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)
    margin, fs, cs, vs = np.full(len(y), base), [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2:
                    continue
                best, whole = 1e-6, g[at].sum() ** 2 / (h[at].sum() + damp)
                for j, edges in enumerate(cuts):
                    gs = np.cumsum(np.bincount(binned[at, j], g[at], len(edges) + 1))
                    hs = np.cumsum(np.bincount(binned[at, j], h[at], len(edges) + 1))
                    gain = gs**2 / (hs + damp) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + damp) - whole
                    i = int(gain[:-1].argmax()) if len(edges) else 0
                    if len(edges) and gain[i] > best:
                        best, f[k], c[k] = gain[i], j, edges[i]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + damp)
        margin += v[leaf]
        fs.append(f), cs.append(c), vs.append(v)
    return Trees(base, depth, np.array(fs), np.array(cs), np.array(vs))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability) of a rising step function, interpolated between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, t, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([float(t), float(w), float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [(s, m) for m, _, lo, hi in blocks for s in dict.fromkeys((lo, hi))]
    return np.array([k for k, _ in knots]), np.array([m for _, m in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.knots[1][0])
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        margin = self.trees.margin(x)
        # within a step of the calibration the margin still ranks, by a hair
        return np.clip(np.interp(margin, *self.knots) * 0.998 + 0.002 / (1 + np.exp(-margin)), 0, 1)


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """share: of toxic rows among all labelled ones, if the sample was drawn by label."""
    y = np.array(toxic, float)
    if len(set(toxic)) < 2:
        return Model(Lexicon({}, {}), None, (np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    sets = [set(_tokens(t)) for t in texts]
    # every fold's other rows must hold both labels
    folds = min(3, int(y.sum()), int((1 - y).sum()))
    fold = np.zeros(len(y), int)
    for label in (0, 1):  # folds that hold both labels alike
        at = np.flatnonzero(y == label)
        fold[at] = np.arange(len(at)) % folds
    least = 2 if y.sum() < 100 else 3 if y.sum() < 1000 else 5
    x = np.zeros((len(y), len(NAMES)))
    for k in range(folds):
        rest = fold != k if folds > 1 else fold == k
        lex = learn_lexicon([s for s, r in zip(sets, rest, strict=True) if r], y[rest], least)
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i], lex)
    # calibrated on margins of trees that have not seen the row
    margin = np.zeros(len(y))
    for k in range(folds):
        rest = fold != k if folds > 1 else fold == k
        margin[fold == k] = boost(x[rest], y[rest]).margin(x[fold == k])
    return Model(learn_lexicon(sets, y, least), boost(x, y), isotonic(margin, y, weight))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` distinct texts of each label among rows that are not held out, picked by a hash of their id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    if not counts:
        return fit([], [])
    by_hash = lambda *more: Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", *more)
    # twice as many ids, for those that are copies
    ids = usable.withColumn("place", F.row_number().over(by_hash())).where(F.col("place") <= 2 * rows).select(F.col("doc_id").alias("picked"), "toxic")
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("picked")).dropDuplicates(["toxic", "text"])
    found = found.withColumn("place", F.row_number().over(by_hash("text"))).where(F.col("place") <= rows)
    # one very long text can't crowd out the rest: each takes its place in the order while there is room
    found = found.withColumn("chars", F.sum(F.length("text")).over(by_hash("text"))).where(F.col("chars") - F.length("text") <= SAMPLE_CHARS)
    got = sorted(found.select("toxic", "place", "text").collect())
    return fit([r["text"] for r in got], [r["toxic"] for r in got], counts.get(1, 0) / sum(counts.values()))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; one narrow pass."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held"], "score": score, "predicted": (score >= 0.5).astype(int)})

    return id_again(docs.select(id_text(), held_out(F.col("doc_id")).alias("held"), text_or_empty().alias("text")).mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int"))
