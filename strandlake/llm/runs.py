"""Runs of repeating words in a text.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends. Every run of two periods and more holds, under the order of words or its reverse, a
longest Lyndon word of length q that starts at one of its places. So each order is scanned from
right to left with a stack of Lyndon words: a word on top is swallowed while the suffix that
starts here is smaller. What is left on top ends the longest Lyndon word of this place; its
length is a candidate period, extended to both sides. Suffixes are compared by their longest common
extension: a few words directly, then binary search over rolling hashes, and the words that
hashes call equal are compared themselves (each stretch once for each distance). There is no
suffix array.

Runs of four periods and six words at least are looked for. In those, all three-word windows occur
again within the period, a quarter of the run at most. Only stretches of such windows are
scanned (found with numpy over a whole batch, by hashes, whose collisions only add windows); a
run lies within one of them with both its ends.

Defined results: null text is the empty text; texts without words have no runs and collapse to
the empty text; words are parted by ASCII white space only; runs come in order of start, then
period; of rows with equal doc_id each is worked on by itself; null doc_ids stay null; texts of any
length are worked on whole; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, text_or_empty

#: A run holds this many periods, and this many words, at least.
PERIODS, WORDS = 4, 6
#: Words in a row that are compared directly before hashes are.
DIRECT = 8
#: Words of the windows that a run repeats; at most ``WORDS - PERIODS + 1``, so that the shortest run has them all.
WINDOW = 3
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
SPACE = r"[\x20\x09-\x0D]+"

_powers = [1]


class Stretch:
    """Consecutive words as numbers, with the longest common extensions of any two places to both sides."""

    def __init__(self, words: list[int]):
        self.words, h = words, 0
        self.hashes = [0]
        for w in words:
            h = (h * _BASE + w + 1) % _MOD
            self.hashes.append(h)
        while len(_powers) <= len(words):
            _powers.append(_powers[-1] * _BASE % _MOD)
        self.raw = np.array(words, "<u4").tobytes()
        self.proved: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, n: int) -> bool:
        h, p = self.hashes, _powers[n]
        return (h[i + n] - h[i] * p - h[j + n] + h[j] * p) % _MOD == 0

    def _proves(self, a: int, b: int, d: int) -> bool:
        """Whether words a to b - 1 equal those ``d`` places on, read themselves; what was read before isn't read again."""
        lo, hi = self.proved.get(d, (a, a))
        if b < lo or hi < a:
            lo = hi = a
        for x, y in ((a, min(b, lo)), (max(a, hi), b)):
            if x < y and self.raw[4 * x : 4 * y] != self.raw[4 * (x + d) : 4 * (y + d)]:
                return False
        self.proved[d] = (min(a, lo), max(b, hi))
        return True

    def _longest(self, top: int, known: int, same) -> int:
        """The largest length up to ``top`` that ``same`` holds for, given that ``known`` does: doubled steps, then halved ones."""
        low, step = known, DIRECT
        while low + step <= top and same(low + step):
            low, step = low + step, 2 * step
        high = min(top + 1, low + step)
        while high - low > 1:
            mid = (low + high) // 2
            if same(mid):
                low = mid
            else:
                high = mid
        return low

    def ahead(self, i: int, j: int) -> int:
        """Words that the suffixes at ``i < j`` have in common."""
        w, top, n = self.words, len(self.words) - j, 0
        near = min(top, DIRECT)
        while n < near and w[i + n] == w[j + n]:
            n += 1
        if n < near or n == top:
            return n
        n = self._longest(top, n, lambda m: self._same(i, j, m))
        if self._proves(i, i + n, j - i) and (n == top or w[i + n] != w[j + n]):
            return n
        return next((m for m in range(top) if w[i + m] != w[j + m]), top)

    def behind(self, i: int, j: int) -> int:
        """Words that the texts before ``i < j`` have in common at their ends."""
        w, n = self.words, 0
        near = min(i, DIRECT)
        while n < near and w[i - n - 1] == w[j - n - 1]:
            n += 1
        if n < near or n == i:
            return n
        n = self._longest(i, n, lambda m: self._same(i - m, j - m, m))
        if self._proves(i - n, i, j - i) and (n == i or w[i - n - 1] != w[j - n - 1]):
            return n
        return next((m for m in range(i) if w[i - m - 1] != w[j - m - 1]), i)

    def runs(self, periods: int = PERIODS, least: int = WORDS) -> set[tuple[int, int, int]]:
        """``start, length, period`` of all runs of so many periods (2 or more) and words."""
        w, n, found = self.words, len(self.words), set()
        for rising in (True, False):
            stack = [n]
            for i in range(n - 1, -1, -1):
                here, common = w[i], 0
                while (j := stack[-1]) < n:
                    if here != w[j]:
                        common = 0
                        if (here < w[j]) is rising:
                            stack.pop()
                            continue
                        break
                    common = self.ahead(i, j)
                    # a suffix that ends within the other one is the smaller
                    if j + common < n and (w[i + common] < w[j + common]) is rising:
                        stack.pop()
                        continue
                    break
                stack.append(i)
                q = j - i
                right = common if j < n else 0
                if periods * q <= n and (right + q >= periods * q or i and w[i - 1] == w[j - 1]):
                    left = self.behind(i, j)
                    if left + q + right >= max(least, periods * q):
                        found.add((i - left, left + q + right, q))
        return found


def stretches(hashes: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: ``from, to`` (exclusive) of words, given the words' hashes and the number of each one's text."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return []
    mixed, odd = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * odd + hashes[k : k + n]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * odd + text_of[:n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    gap = np.where(mixed[order[1:]] == mixed[order[:-1]], order[1:] - order[:-1], n)
    near = np.full(n, n, np.int64)
    near[order[:-1]] = gap
    near[order[1:]] = np.minimum(near[order[1:]], gap)
    near[text_of[:n] != text_of[WINDOW - 1 :]] = n
    keep = near < n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        words = last - first + WINDOW - 1
        # a window that occurs again no nearer than a quarter of its stretch is in no run
        most = np.where(words >= WORDS, words // PERIODS, 0)
        fits = keep.copy()
        fits[keep] = near[keep] <= np.repeat(most, last - first)
        if fits.sum() == keep.sum():
            return [(a, b + WINDOW - 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        keep = fits


def runs_of_texts(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs as ``start, length, period``, and the text with only the first period of each, words joined by one space."""
    split = [t.split() for t in texts]  # bytes are split at ASCII white space only
    ends = np.cumsum([len(s) for s in split])
    words = [w for s in split for w in s]
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(hashes, text_of):
        number: dict[bytes, int] = {}
        t = int(text_of[a])
        at = a - int(ends[t]) + len(split[t])
        found[t] += [(s + at, n, q) for s, n, q in Stretch([number.setdefault(w, len(number)) for w in words[a:b]]).runs()]
    out = []
    for ws, runs in zip(split, found, strict=True):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            gone = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in runs:
                gone[s + q] += 1
                gone[s + n] -= 1
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        out.append((runs, b" ".join(ws)))
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: runs are structs of start, length and period.

    One narrow pass over the texts, in batches of bounded bytes; nothing is shuffled.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = runs_of_texts(batch.column(1).to_pylist())
            flat = [r for runs, _ in done for r in runs]
            parts = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            offsets = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in done])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([c for _, c in done], pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, schema)


def loop_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents, by the hash of the id, the words from some place on repeat those that follow it.

    Null ids have no hash: their texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.array_remove(F.split(text_or_empty(), SPACE), "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), looped).otherwise(text_or_empty()).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of ``find_runs``' rows: the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    length: Column = -best["minus"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).cast("long").alias("exponent_milli"),
        hashed(line).alias("runs_sha256"),
        hashed(F.col("collapsed")).alias("collapsed_sha256"),
    )
