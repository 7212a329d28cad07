"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import hex64, near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", hex64(found["fp"]).alias("fingerprint"), "component_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import dedup_documents

    return dedup_documents(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_documents

    return scan_documents(documents(spark, sf_dir)).drop("found")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score_documents

    docs = documents(spark, sf_dir)
    return score_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests, find_runs, loop_tails

    return digests(find_runs(loop_tails(documents(spark, sf_dir))))


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiers import pack_tiers

    return pack_tiers(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import digests, lloyd

    return digests(lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def _secrets_sql() -> str:
    """Each rule's matches and the pieces between them, placed by running lengths."""
    from .secrets import BASE, RULES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT r, {quoted(x.kind)} AS kind, {i} AS rank, {x.least} AS least, unnest(range(len(string_split_regex(text, {quoted(x.pattern)})))) AS n, unnest(string_split_regex(text, {quoted(x.pattern)})) AS gap, "
        f"unnest(regexp_extract_all(text, {quoted(x.pattern)}, 0)) AS m, unnest(regexp_extract_all(text, {quoted(x.pattern)}, {x.group})) AS v FROM d"
        for i, x in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quoted(x.kind)}) AS n_{x.kind}" for x in BASE)
    known = ", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), e AS ({each}),
    p AS (SELECT r, kind, rank, least, v, m, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r, kind ORDER BY n) AS BIGINT) AS z FROM e),
    f AS (SELECT r, kind, rank, z - length(m) AS a, kind || ':' || (z - length(m)) || ':' || z AS span FROM p WHERE m IS NOT NULL AND length(v) >= least),
    g AS (SELECT r, {counts}, coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(BASE)}), '') AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM f GROUP BY r)
    SELECT doc_id, {known}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def _repeats_sql(width: int = 400) -> str:
    """Every string of ``width`` bytes by its hash, those that start twice joined to runs, and what is left between them."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS INT), {2 * width})) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - {width - 1})) AS i FROM d WHERE length(h) >= {2 * width})),
    t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
    j AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {width} THEN 0 ELSE 1 END AS fresh FROM t),
    s AS (SELECT r, min(i) AS a, max(i) + {width} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM j) GROUP BY r, g),
    x AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM s),
    y AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS fin, string_agg(substr(h, CAST(2 * last + 1 AS INT), CAST(2 * (a - last) AS INT)), '' ORDER BY a) AS kept FROM x JOIN d USING (r) GROUP BY r)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(fin, 0) + 1 AS INT)))) AS kept_sha256 FROM d LEFT JOIN y USING (r)"""


def _clusters_sql(k: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """Components as rows; each round's nearest centroid by the least of distance and number in one integer."""
    out = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF isfinite(x)]) = {dims}))""",
        f"p AS MATERIALIZED (SELECT r, unnest(range({dims})) AS j, unnest(v) AS x FROM k)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS j, unnest(v) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM k WHERE vec_id IS NOT NULL) WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, min(d * {k} + c) AS m FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM p JOIN c{t} USING (j) GROUP BY r, c) GROUP BY r)")
        if t < rounds:
            means = f"SELECT m % {k} AS c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN p USING (r) GROUP BY 1, 2"
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n + n) % n)) // n, y) AS y FROM c{t} LEFT JOIN ({means}) USING (c, j))")
    return f"""WITH {", ".join(out)}, f AS (SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance FROM a{rounds} JOIN k USING (r)),
    h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN h ON c = cluster"""


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, models or tokenizers and measures edits in bytes: the other queries have brute-force twins in the tests."""
    return {"op8_suffix_array_dedup": _repeats_sql(), "op9_secret_scan": _secrets_sql(), "op13_centroid_clustering": _clusters_sql()}
