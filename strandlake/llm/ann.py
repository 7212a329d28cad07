"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard.

Vectors are dealt by hash to shards of bounded size. In each shard a graph is grown in
batches: greedy beam searches over the graph so far propose neighbours for the new vectors,
relaxed pruning keeps an edge only if no kept neighbour is clearly nearer to its end, and
back edges are pruned in the same way. Every query then runs a beam search in every shard;
the best of all shards, with exact double-precision products, are the answer.

For graphs that use distances, vectors get one more component that makes all norms of the
shard equal (so nearest by distance is largest by product); searches use the products alone.
Equal vectors are one node that stands for its smallest ids: no more than k + 1 of them can
be among any query's k nearest, as ties go to the smaller id.

Defined results: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components take no part; a query never finds its own row, but copies of
it; a repeated vec_id asks once, by its smallest vector; fewer candidates than k give fewer rows; no rows, no result.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, spool

K = 20
#: Distinct vectors of a shard on average: bounds a task's memory.
SHARD = 6000
DEGREE, BEAM, RELAX = 32, 64, 1.2
#: Queries that are searched side by side.
LANES = 512
#: Queries that a task searches a shard for, on average.
BLOCK = 8000


def usable(vector: Column) -> Column:
    """Every component finite and not null, and any of them not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(data: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step. Returns node ids and products, best first (-1 pads).

    graph: (nodes, degree) with -1 where there is no edge. Each step every query expands its
    best node that has not been expanded; a query is done when its whole beam has been.
    """
    n, q = len(data), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, np.float32)
    first = start[:beam]
    ids[:, : len(first)] = first
    score[:, : len(first)] = queries @ data[first].T
    done = np.zeros((q, beam), bool)
    met = np.zeros((q, n), bool)
    met[:, first] = True
    live = np.arange(q)
    while len(live):
        open_score = np.where(done[live] | (ids[live] < 0), -np.inf, score[live])
        best = open_score.argmax(1)
        go = open_score[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        near = graph[ids[live, best]]
        rows = np.broadcast_to(live[:, None], near.shape)
        fresh = (near >= 0) & ~met[rows, near]
        met[rows[fresh], near[fresh]] = True
        products = np.einsum("qd,qkd->qk", queries[live], data[near], optimize=False)
        products[~fresh] = -np.inf
        ids_all = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        score_all = np.concatenate([score[live], products], 1)
        done_all = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-score_all, beam - 1, 1)[:, :beam]
        ids[live], score[live], done[live] = (np.take_along_axis(x, top, 1) for x in (ids_all, score_all, done_all))
    order = np.argsort(-score, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def robust_prune(data: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point, up to ``degree`` of its pool (-1 pads): the nearest is kept, and what lies
    ``relax`` times nearer to a kept one than to the point goes; again until none is left."""
    m, w = pool.shape
    ok = (pool >= 0) & (pool != points[:, None])
    # repeated ids count once
    order = np.argsort(pool, 1, kind="stable")
    sorted_pool = np.take_along_axis(pool, order, 1)
    again = np.zeros((m, w), bool)
    np.put_along_axis(again, order[:, 1:], sorted_pool[:, 1:] == sorted_pool[:, :-1], 1)
    ok &= ~again
    vectors = data[pool]
    norms = np.einsum("mwd,mwd->mw", vectors, vectors)
    own = data[points]
    to_point = norms + np.einsum("md,md->m", own, own)[:, None] - 2 * np.einsum("md,mwd->mw", own, vectors)
    kept = np.full((m, degree), -1, np.int64)
    rows = np.arange(m)
    for k in range(degree):
        dist = np.where(ok, to_point, np.inf)
        best = dist.argmin(1)
        there = dist[rows, best] < np.inf
        if not there.any():
            break
        kept[there, k] = pool[rows, best][there]
        ok[rows, best] = False
        chosen = vectors[rows, best]
        to_kept = norms + norms[rows, best][:, None] - 2 * np.einsum("md,mwd->mw", chosen, vectors)
        ok &= ~there[:, None] | (relax * relax * to_kept > to_point)
    return kept


def build(data: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The graph of ``data`` (rows of equal norm) and the nodes that searches start from."""
    n = len(data)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int64)
    order = rng.permutation(n)
    start = order[: max(1, min(8, n))]
    head = order[: min(n, 2 * degree)]
    # the first vectors know each other
    graph[head] = robust_prune(data, head, np.broadcast_to(head, (len(head), len(head))).copy(), degree, relax)
    at, size = len(head), len(head)
    while at < n:
        part = order[at : at + size]
        for a in range(0, len(part), LANES):
            p = part[a : a + LANES]
            found, _ = beam_search(data, graph, start, data[p], beam)
            graph[p] = robust_prune(data, p, found, degree, relax)
        # back edges: what each old node gets, with what it has, is pruned again
        src = np.repeat(part, degree)
        dst = graph[part].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
        by = np.argsort(-count, kind="stable")
        nodes, begin, count, a = nodes[by], begin[by], count[by], 0
        while a < len(nodes):  # hubs get many edges at once: fewer of them side by side
            wide = int(count[a])
            step = max(1, 64 * LANES // (degree + wide))
            who, b, c = nodes[a : a + step], begin[a : a + step], count[a : a + step]
            new = np.where(np.arange(wide) < c[:, None], src[np.minimum(b[:, None] + np.arange(wide), len(src) - 1)], -1)
            graph[who] = robust_prune(data, who, np.concatenate([graph[who], new], 1), degree, relax)
            a += step
        at += len(part)
        size = min(2 * size, 1024)
    return graph, start


def level(data: np.ndarray) -> np.ndarray:
    """``data`` with one more component that makes all norms equal, in single precision."""
    square = np.einsum("nd,nd->n", data, data)
    return np.concatenate([data, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(vec_id, embedding)`` among ``vectors(vec_id, embedding)``, each without its own row."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows, asked = clean(vectors), clean(queries)
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("embedding") == width["w"]), asked.where(F.size("embedding") == width["w"])

    # zero of either sign is one value; the smallest ids of equal vectors, limited before the shuffle
    key = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.select("vec_id", key.alias("embedding")).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= k + 1)
    nodes = spool(first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    # a vec_id asks once; each shard answers every query, in blocks of queries
    asked = spool(asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")))
    blocks = max(1, -(-asked.count() // BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    to_ask = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))

    def graphs(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(pdf["embedding"].to_numpy())
        graph, start = build(level(data))
        return pd.DataFrame({"shard": [key[0]], "graph": [graph.astype("<i4").tobytes()], "start": [start.astype("<i4").tobytes()], "data": [data.astype("<f8").tobytes()], "n": [len(data)], "ids": [[list(x) for x in pdf["ids"]]]})

    built = spool(dealt.groupBy("shard").applyInPandas(graphs, "shard int, graph binary, start binary, data binary, n int, ids array<array<long>>"))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        g = left.iloc[0]
        data = np.frombuffer(g["data"], "<f8").reshape(g["n"], -1)
        graph, start = np.frombuffer(g["graph"], "<i4").reshape(g["n"], -1).astype(np.int64), np.frombuffer(g["start"], "<i4").astype(np.int64)
        q = np.stack(right["embedding"].to_numpy())
        single, ids, out = data.astype(np.float32), g["ids"], []
        for a in range(0, len(q), LANES):
            found, _ = beam_search(single, graph, start, q[a : a + LANES].astype(np.float32), beam)
            for i in range(len(found)):
                node = found[i][found[i] >= 0]
                exact = data[node] @ q[a + i]
                qid = right["query_id"].iloc[a + i]
                # each node brings its ids; the k best of this shard go on
                near = sorted((-s, v) for s, x in zip(exact, node, strict=True) for v in ids[x] if v != qid)[:k]
                out += [(qid, v, -s) for s, v in near]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = built.select("*", every(blocks, "block")).groupBy("shard", "block").cogroup(to_ask.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
