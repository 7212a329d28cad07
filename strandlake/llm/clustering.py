"""Lloyd's clustering of vectors with two trees.

Vectors are dealt to blocks of bounded size, and each block gets a cover tree once, which is
written with it: nets of halving scales, whose centers keep apart by the scale and cover all points of
the block within it; a center hangs below the nearest one of the net before. Each round makes such
a tree of the centroids and walks both: a pair of nodes is dropped when no vector below one can
have its nearest centroid below the other (their centers are further apart, less both radii, than
some centroid is at most); the wider node of a pair is opened. A node whose only pair left has one
centroid goes to it whole, its sum and count are known from running totals. Pairs of leaves are
compared exactly, in integers. Tasks send a sum and a count for each centroid, never vectors.

Bounds are compared with a slack over what rounding can do, so ties are always left to the
leaves, where the smaller number of a centroid wins.

Defined results: vectors that are null, of another length, or holding null or non-finite components
are left out; repeated rows are vectors of their own; null ids stay null, and such vectors are never
starting centroids; of equal ids the vector that sorts first starts; fewer vectors with an id than ``k``
give as many centroids; no vectors (or none with an id), no result; a centroid without vectors stays
where it is; distances and sums beyond 2**63 - 1 are returned as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, small_side, spool

#: Vectors of a block: a tree takes time and memory that grow with the square of it.
BLOCK = 1024
DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Components up to which squared distances stay exact in 64 bits.
EXACT = 1 << 26
_MOST = 2**63 - 1
_SLACK = 1e-9


def whole(values: np.ndarray) -> np.ndarray:
    """Integers (given as doubles) as 64-bit ones, or as Python's where squares wouldn't fit."""
    if not values.size or np.abs(values).max() <= EXACT:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row."""
    d = a - b
    return (d * d).sum(axis=1)


def _root(sq: np.ndarray) -> np.ndarray:
    return np.sqrt(sq.astype(np.float64))


class CoverTree:
    """Over the rows of ``points`` (distinct). Leaves are numbered along the tree, so a node is a stretch of them.

    For each node: ``center`` (a leaf), ``lo, hi`` (its leaves), ``radius``, ``first, count`` (its children); leaf nodes have no children.
    ``order`` has the row of each leaf.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        near = points.astype(np.float64)
        sq = (near * near).sum(axis=1)
        # products of integers this small are exact in doubles; of larger ones distances are taken anew
        exact = float(sq.max(initial=0)) < 2**50
        gram = near @ near.T if exact else None

        def distances(i: int) -> np.ndarray:
            if gram is not None:
                return np.sqrt(np.maximum(sq + sq[i] - 2 * gram[i], 0))
            return _root(squared(points, points[i : i + 1]))

        hangs: list[list[list[int]]] = [[] for _ in range(n)]
        owner, least = np.zeros(n, np.int64), distances(0)
        scale = float(least.max(initial=0))
        while (widest := least.max(initial=0)) > 0:
            scale = min(scale, float(widest)) / 2
            above, added = owner.copy(), []
            while True:
                c = int(least.argmax())
                if least[c] <= scale:
                    break
                d = distances(c)
                closer = d < least
                owner[closer], least[closer] = c, d[closer]
                least[c] = 0
                added.append(c)
            below: dict[int, list[int]] = {}
            for c in added:
                below.setdefault(int(above[c]), []).append(c)
            for p, cs in below.items():
                hangs[p].append(cs)
        # nodes: a center and how many of its levels have been opened
        nodes, first, count = [(0, 0)], [], []
        at = 0
        while at < len(nodes):
            p, level = nodes[at]
            first.append(len(nodes))
            if level < len(hangs[p]):
                nodes.append((p, level + 1))
                nodes += [(c, 0) for c in hangs[p][level]]
            count.append(len(nodes) - first[-1])
            at += 1
        self.first, self.count = np.array(first), np.array(count)
        size = [0] * len(nodes)
        for v in range(len(nodes) - 1, -1, -1):
            size[v] = sum(size[first[v] : first[v] + count[v]]) or 1
        lo = [0] * len(nodes)
        for v in range(len(nodes)):
            x = lo[v]
            for c in range(first[v], first[v] + count[v]):
                lo[c] = x
                x += size[c]
        self.lo = np.array(lo)
        self.hi = self.lo + np.array(size)
        self.order = np.zeros(n, np.int64)
        for v, (p, _) in enumerate(nodes):
            if not count[v]:
                self.order[lo[v]] = p
        leaf_of = np.empty(n, np.int64)
        leaf_of[self.order] = np.arange(n)
        self.center = leaf_of[[p for p, _ in nodes]]
        self.radius = np.zeros(len(nodes))
        for v, (p, _) in enumerate(nodes):
            if count[v]:
                self.radius[v] = distances(p)[self.order[lo[v] : lo[v] + size[v]]].max()

    def parts(self) -> dict[str, np.ndarray]:
        return {"center": self.center, "lo": self.lo, "hi": self.hi, "radius": self.radius, "first": self.first, "count": self.count}


def _opened(tree: dict[str, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes``, and for each which of ``nodes`` it is below."""
    n = tree["count"][nodes]
    of = np.repeat(np.arange(len(nodes)), n)
    return tree["first"][nodes][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def nearest(tree: dict[str, np.ndarray], points: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """``centroid, lo, hi`` of stretches of leaves that together are all of them, and how many distances it took.

    ``points`` are the rows in order of leaves; of centroids alike the first one stands for all.
    """
    rows, number = np.unique(centroids.astype(np.float64), axis=0, return_index=True)
    whole_rows = centroids[number]
    ctree = CoverTree(whole_rows)
    number, whole_rows = number[ctree.order], whole_rows[ctree.order]
    ct = ctree.parts()
    alike = (points.dtype == object) != (whole_rows.dtype == object)
    exact_points, exact_rows = (points.astype(object), whole_rows.astype(object)) if alike else (points, whole_rows)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done: list[tuple[int, int, int]] = []
    taken = 0
    while len(v):
        sq = squared(exact_points[tree["center"][v]], exact_rows[ct["center"][c]])
        taken += len(sq)
        d, r, R = _root(sq), tree["radius"][v], ct["radius"][c]
        most = np.full(len(tree["center"]), np.inf)
        np.minimum.at(most, v, (d + r) * (1 + _SLACK))
        keep = ~((d - r - R) * (1 - _SLACK) - _SLACK * (r + R) > most[v])
        v, c, sq = v[keep], c[keep], sq[keep]
        pairs = np.bincount(v, minlength=len(most))
        leaf_v, leaf_c = tree["count"][v] == 0, ct["count"][c] == 0
        # one centroid left: the whole node is its
        alone = (pairs[v] == 1) & leaf_c
        done += zip(number[ct["center"][c[alone]]].tolist(), tree["lo"][v[alone]].tolist(), tree["hi"][v[alone]].tolist(), strict=True)
        # leaves against leaves: exactly, the smaller number of equals
        open_c = np.bincount(v, weights=~leaf_c, minlength=len(most))
        final = leaf_v & ~alone & (open_c[v] == 0)
        if final.any():
            fv, fc, fs = v[final], number[ct["center"][c[final]]], sq[final]
            order = sorted(range(len(fv)), key=lambda i: (fv[i], fs[i], fc[i])) if fs.dtype == object else np.lexsort((fc, fs, fv))
            fv, fc = fv[order], fc[order]
            best = np.flatnonzero(np.concatenate([[True], fv[1:] != fv[:-1]]))
            done += zip(fc[best].tolist(), tree["lo"][fv[best]].tolist(), tree["hi"][fv[best]].tolist(), strict=True)
        rest = ~alone & ~final
        v, c = v[rest], c[rest]
        if not len(v):
            break
        # all pairs of a vector node are treated alike: its wider centroid nodes are opened, or else it is itself
        wide = (ct["count"][c] > 0) & ((ct["radius"][c] > tree["radius"][v]) | (tree["count"][v] == 0))
        some = np.zeros(len(most), bool)
        some[v[wide]] = True
        by_c, by_v, stay = wide, ~some[v], some[v] & ~wide
        kids_c, of_c = _opened(ct, c[by_c])
        kids_v, of_v = _opened(tree, v[by_v])
        v, c = np.concatenate([v[by_c][of_c], kids_v, v[stay]]), np.concatenate([kids_c, c[by_v][of_v], c[stay]])
    return done, taken


_BLOCKS = "ids array<long>, leaf binary, points binary, center binary, lo binary, hi binary, radius binary, first binary, count binary"
_INTS = ("center", "lo", "hi", "first", "count")


def kept(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """``vec_id, x``: of every vector that takes part ``floor(scale * component)``, as doubles."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    fits = (F.size("x") == dims) & F.forall("x", fine)
    scaled = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("x is not null").where(fits)
    return scaled.select("vec_id", F.transform("x", lambda e: e * F.lit(float(scale))).alias("x"))


def blocks(vectors: DataFrame, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """A row for each block of ``kept`` vectors: ids, the leaf of each, and the cover tree of the distinct ones."""
    arrow_batches(vectors.sparkSession)

    def made(ids: list[int | None], x: np.ndarray) -> pa.RecordBatch:
        rows, inverse = np.unique(x, axis=0, return_inverse=True)
        tree = CoverTree(whole(rows))
        leaf_of = np.empty(len(rows), np.int64)
        leaf_of[tree.order] = np.arange(len(rows))
        parts: dict[str, Any] = {"leaf": leaf_of[inverse.ravel()].astype("<i4"), "points": rows[tree.order].astype("<f8")}
        parts |= {k: p.astype("<i4" if k in _INTS else "<f8") for k, p in tree.parts().items()}
        names = [f.split(" ")[0] for f in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64()))] + [pa.array([parts[k].tobytes()], pa.binary()) for k in names[1:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)))
            if len(ids) >= block:
                x = np.concatenate(parts)
                for a in range(0, len(ids) - block + 1, block):
                    yield made(ids[a : a + block], x[a : a + block])
                left = len(ids) % block
                ids, parts = ids[len(ids) - left :], [x[len(x) - left :]]
        if ids:
            yield made(ids, np.concatenate(parts))

    return vectors.mapInArrow(run, _BLOCKS)


def _read(batch: pa.RecordBatch, i: int, dims: int) -> tuple[list[int | None], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    raw = {f.name: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema)}
    tree = {k: np.frombuffer(raw[k], "<i4").astype(np.int64) for k in _INTS} | {"radius": np.frombuffer(raw["radius"], "<f8")}
    return raw["ids"], np.frombuffer(raw["leaf"], "<i4"), whole(np.frombuffer(raw["points"], "<f8").reshape(-1, dims)), tree


def sums(stored: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> DataFrame:
    """``cluster, n, total`` (array of decimal): a row for each task and centroid that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = whole(np.array(centroids, dtype=np.float64))
        count, total = [0] * len(centroids), [np.zeros(dims, object) for _ in centroids]
        for batch in batches:
            for i in range(batch.num_rows):
                _, leaf, points, tree = _read(batch, i, dims)
                weight = np.bincount(leaf, minlength=len(points))
                zero = np.zeros((1, dims), points.dtype)
                running = np.concatenate([zero, np.cumsum(points * weight[:, None].astype(points.dtype), axis=0)])
                heads = np.concatenate([[0], np.cumsum(weight)])
                for c, lo, hi in nearest(tree, points, known)[0]:
                    count[c] += int(heads[hi] - heads[lo])
                    total[c] = total[c] + (running[hi] - running[lo]).astype(object)
        there = [c for c in range(len(centroids)) if count[c]]
        data = [pa.array(there, pa.int32()), pa.array([count[c] for c in there], pa.int64()), pa.array([[Decimal(int(x)) for x in total[c]] for c in there], pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(data, ["cluster", "n", "total"])

    return stored.mapInArrow(run, "cluster int, n long, total array<decimal(38,0)>")


def assigned(stored: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = whole(np.array(centroids, dtype=np.float64))
        for batch in batches:
            for i in range(batch.num_rows):
                ids, leaf, points, tree = _read(batch, i, dims)
                label = np.empty(len(points), np.int64)
                for c, lo, hi in nearest(tree, points, known)[0]:
                    label[lo:hi] = c
                a, b = (points.astype(object), known.astype(object)) if (points.dtype == object) != (known.dtype == object) else (points, known)
                distance = np.minimum(squared(a, b[label]), _MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label[leaf].astype(np.int32)), pa.array(distance[leaf])], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The ``k`` vectors whose ids hash least (SHA-256 of ``1:`` and the id), in that order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where("vec_id is not null").select(hashed.alias("h"), F.transform("x", lambda e: e).alias("x")).orderBy("h", "x").limit(k)
    return [[int(np.floor(e)) for e in r["x"]] for r in first.collect()]


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` (array of decimal) of every vector that takes part.

    What comes to the driver is bounded by ``k`` and ``dims``.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    some = kept(vectors, dims, scale)
    stored = spool(blocks(some, dims, block))
    centroids = starts(some, k)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<decimal(38,0)>"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        each = sums(stored, centroids, dims).select("cluster", "n", F.posexplode("total").alias("at", "value"))
        found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
        for r in found:
            centroids[r["cluster"]][r["at"]] = int(r["value"]) // r["n"]
    rows = spool(assigned(stored, centroids, dims))
    inertia = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(inertia.values()), _MOST)
    about = [(c, min(v, _MOST), total, [Decimal(x) for x in centroids[c]]) for c, v in inertia.items()]
    named = spark.createDataFrame(about, "number int, cluster_inertia long, inertia long, centroid array<decimal(38,0)>")
    return rows.join(small_side(named), F.col("cluster") == F.col("number")).drop("number")


def digests(found: DataFrame) -> DataFrame:
    """``lloyd``'s rows with a hash in place of the centroid."""
    text: Column = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))
