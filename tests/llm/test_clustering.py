import hashlib
import math
import os
import random

import numpy as np

from strandlake.llm.clustering import CoverTree, digests, lloyd, nearest, whole


def brute(rows, k=16, rounds=3, dims=64):
    """Plain Lloyd in Python's integers."""
    some = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cents = [v for _, v in sorted(((sha(f"1:{i}"), v) for i, v in some if i is not None))[:k]]
    if not cents:
        return []
    to = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        mine = [to(v)[1] for _, v in some]
        for n in range(len(cents)):
            if members := [v for (_, v), m in zip(some, mine, strict=True) if m == n]:
                cents[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, *to(v)) for i, v in some]
    per = {n: sum(d for _, d, m in out if m == n) for n in range(len(cents))}
    big = 2**63 - 1
    return [(i, n, min(d, big), min(per[n], big), min(sum(per.values()), big), sha(",".join(map(str, cents[n])))) for i, d, n in out]


def vectors(rnd, n, dims=64):
    heads = [[rnd.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(7)]
    return [[x + rnd.gauss(0, 0.05) for x in rnd.choice(heads)] for _ in range(n)]


def test_cover_tree_covers_and_separates():
    rnd = np.random.default_rng(1)
    for n, dims, top in ((1, 3, 5), (2, 2, 1), (200, 2, 40), (300, 8, 9)):
        points = np.unique(rnd.integers(-top, top + 1, (n, dims)), axis=0)
        tree = CoverTree(points)
        p = points[tree.order]
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        leaves = np.flatnonzero(tree.count == 0)
        assert sorted(tree.lo[leaves].tolist()) == list(range(len(points)))
        for v in range(len(tree.count)):
            d = np.sqrt(((p[tree.lo[v] : tree.hi[v]] - p[tree.center[v]]) ** 2).sum(axis=1))
            assert d.max() <= tree.radius[v] + 1e-9
            kids = range(tree.first[v], tree.first[v] + tree.count[v])
            if kids:
                assert tree.lo[kids[0]] == tree.lo[v] and tree.hi[kids[-1]] == tree.hi[v] and tree.center[kids[0]] == tree.center[v]
                c = p[tree.center[list(kids)]]
                # siblings are different points
                gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[np.triu_indices(len(c), 1)]
                assert gaps.min() > 0


def test_walk_agrees_with_all_distances_and_saves_some():
    rnd = np.random.default_rng(2)
    for dims, n, spread in ((2, 800, 1000), (3, 500, 6), (64, 300, 40)):
        points = np.unique(rnd.integers(-spread, spread, (n, dims)), axis=0)
        tree = CoverTree(points)
        p = points[tree.order]
        cents = rnd.integers(-spread, spread, (16, dims))
        cents[5] = cents[9]
        got = np.full(len(p), -1)
        done, taken = nearest(tree.parts(), p, cents)
        for c, lo, hi in done:
            assert (got[lo:hi] == -1).all()
            got[lo:hi] = c
        assert (got == ((p[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        if dims == 2:
            assert taken < len(p) * 16 / 2


def test_lloyd_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, v) for i, v in enumerate(vectors(rnd, 400))]
    rows += [(i + 400, rows[7][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (2**53 + 1, rows[9][1]), (2**53 + 2, [0.0] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS x").repartition(3)
    for block in (1024, 50):
        got = digests(lloyd(df, block=block))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_same_rows_as_sql(spark):
    import duckdb
    import pytest

    from strandlake.llm.queries import op13_centroid_clustering, oracle_sql

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    got = op13_centroid_clustering(spark, folder)
    rel = duckdb.connect().sql(oracle_sql()["op13_centroid_clustering"].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'"))
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert lloyd(spark.createDataFrame([], schema)).count() == 0
    assert lloyd(spark.createDataFrame([(None, [1.0] * 64)], schema)).count() == 0
    few = [(i, [float(i % 3)] * 64) for i in range(5)]
    assert sorted(map(tuple, digests(lloyd(spark.createDataFrame(few, schema))).collect()), key=str) == sorted(brute(few), key=str)
    large = [(i, [3e30 * (i % 4), -(2.0**70)] + [float(i)] * 62) for i in range(30)]
    assert sorted(map(tuple, digests(lloyd(spark.createDataFrame(large, schema))).collect()), key=str) == sorted(brute(large), key=str)
    assert whole(np.array([[2.0**30]])).dtype == object
