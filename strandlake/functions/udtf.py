"""Table functions that give SQL users the k-mer verbs.

They are SQL functions over Spark's own array functions: a lateral call becomes a generator within
the plan, and no Python runs. Null and too short sequences give no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_KMERS = """CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS TABLE (at INT, kmer STRING)
RETURN SELECT i AS at, substring(kmers.seq, i, kmers.k) AS kmer
FROM (SELECT explode(CASE WHEN kmers.k >= 1 AND length(kmers.seq) >= kmers.k THEN sequence(1, length(kmers.seq) - kmers.k + 1) END) AS i)"""

# places: of each k-mer's least m-mer, the leftmost of equals; firsts: of the k-mers where that place is another than before
_SUPERMERS = """CREATE OR REPLACE TEMPORARY FUNCTION supermers(seq STRING, k INT, m INT) RETURNS TABLE (minimizer STRING, start INT, supermer STRING)
RETURN SELECT substring(supermers.seq, s.place, supermers.m) AS minimizer, s.first - 1 AS start, substring(supermers.seq, s.first, s.n + supermers.k - 1) AS supermer
FROM (SELECT explode(CASE WHEN supermers.m >= 1 AND supermers.m < supermers.k AND length(supermers.seq) >= supermers.k THEN
    transform(array(transform(sequence(1, length(supermers.seq) - supermers.k + 1), i ->
        array_min(transform(sequence(i, i + supermers.k - supermers.m), j -> struct(substring(supermers.seq, j, supermers.m) AS mmer, j AS place))).place)),
      places -> transform(array(filter(sequence(1, size(places)), i -> i = 1 OR places[i - 1] <> places[greatest(i - 2, 0)])),
        firsts -> transform(firsts, (f, x) -> struct(places[f - 1] AS place, f AS first, coalesce(get(firsts, x + 1), size(places) + 1) - f AS n)))[0])[0] END) AS s)"""


def register(spark: SparkSession) -> None:
    """``SELECT * FROM kmers(seq, k)``, and ``supermers(seq, k, m)`` with lexicographic minimizers, for this session."""
    spark.sql(_KMERS)
    spark.sql(_SUPERMERS)
