import math

import numpy as np

from strandlake.llm.ann import search

SCHEMA = "vec_id long, embedding array<float>, label string"


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def vectors(n, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


def test_recall_and_exact_scores_over_shards(spark):
    rows = vectors(3000)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = search(df, df.where("vec_id % 20 = 0"), shard=900).collect()
    want = exact(rows, rows[::20], 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    by_id = dict(rows)
    assert set(found) == set(want)
    for q, rs in found.items():
        assert [r.rank for r in rs] == list(range(1, 21)) and all(r.vec_id != q for r in rs)
        assert all(abs(r.score - np.dot(np.array(by_id[q], float), np.array(by_id[r.vec_id], float))) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
    assert np.mean([len({r.vec_id for r in found[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_copies_and_unusable_vectors(spark):
    rows = vectors(60, 4) + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)]
    bad = [(2000, None), (2020, [0.0] * 4), (2040, [math.nan, 1.0, 1.0, 1.0]), (2060, [math.inf, 1.0, 1.0, 1.0]), (2080, [None, 1.0, 1.0, 1.0]), (2100, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (2120, [])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + bad], SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), shard=30).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == want
    few = df.where("vec_id < 3")
    assert {(r.query_id, r.vec_id) for r in search(few, few).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert search(df.where("false"), df).count() == 0 and search(df, df.where("false")).count() == 0
