"""The registered queries of the k-mer engine, each with its SQL twin.

The driver's tables hold no sequences, so reads are derived: the MD5 of a key, its hex digits
mapped to bases. Files that round-trip queries write go to the folder that driver and
executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import is_forward, reverse_complement
from ..operators import minimizer
from ..operators.hitting import bundled, hitting_set
from ..operators.index import KmerIndex, Params
from ..operators.minimizer import Ordering
from ..operators.numbering import numbered
from ..operators.superindex import SupermerIndex, count_by_supermers
from ..operators.sequence import count_kmers, dealt, fragments, kmers, titles, with_reverse_complements
from ..session import move, scratch_path
from ..sources import sequences, sinks

HEX = "0123456789abcdef"
CLEAN, DIRTY = "ACGTACGTACGTACGT", "ACGTacgtACGUACGN"
K, M, KM = 21, 4, 9


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = Query(f, sql)
        return f

    return add


# --- reads, in both languages ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(key: Column, to: str = CLEAN) -> Column:
    return F.translate(F.md5(key.cast("string").cast("binary")), HEX, to)


def keys(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table's keys, in tasks of as many rows however large its files are; equal ones, whose reads are equal, together."""
    return dealt(table(spark, d, name).select(key), key)


def part_reads(spark, d, to=CLEAN):
    return keys(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("read_id"), bases(F.col("p_partkey"), to).alias("seq"))


def line_reads(spark, d):
    return keys(spark, d, "lineitem", "l_partkey").select(bases(F.col("l_partkey")).alias("seq"))


def sql_bases(key: str, to: str = CLEAN) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)), '{HEX}', '{to}')"


PART = f"SELECT p_partkey AS read_id, {sql_bases('p_partkey')} AS seq FROM part"


def sql_kmers(k: int, source: str, *keep: str) -> str:
    cols = "".join(f"{c}, " for c in keep)
    return f"SELECT {cols}i, substr(seq, CAST(i AS INT), {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM ({source}) WHERE length(seq) >= {k})"


CAP = "CAST(least({}, 2147483647) AS INTEGER)"


def sql_count(k: int, source: str) -> str:
    return f"SELECT kmer, {CAP.format('count(*)')} AS count FROM ({sql_kmers(k, source)}) GROUP BY kmer"


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
#: Whole tables whose keys, each times a factor, give operands that share some reads and hold some of their own.
A, B, C, N = ("lineitem", "l_partkey", 1), ("orders", "o_custkey", 2), ("lineitem", "l_suppkey", 3), ("customer", "c_custkey", 4)


def index(spark, d, source: tuple[str, str, int] = A) -> KmerIndex:
    name, key, times = source
    reads = table(spark, d, name).select(bases(F.col(key).cast("long") * times).alias("seq"))
    # the reads repeat about thirty times: equal ones are counted before they are cut
    return KmerIndex.of_reads(reads, Params(K), pregroup=True)


def sql_index(source: tuple[str, str, int] = A) -> str:
    name, key, times = source
    return sql_count(K, f"SELECT {sql_bases(f'CAST({key} AS BIGINT) * {times}')} AS seq FROM {name}")


# --- counting ------------------------------------------------------------------------------------


@query("kmer_count", sql_index())
def kmer_count(spark, d):
    return count_kmers(line_reads(spark, d), K)


@query("kmer_count_pregrouped", sql_index())
def kmer_count_pregrouped(spark, d):
    return count_kmers(line_reads(spark, d), K, pregroup=True)


_LONG = " || ".join(sql_bases(f"CAST(l_partkey AS VARCHAR) || '#{i}'") for i in range(3))


@query("kmer_count_long_k55", sql_count(55, f"SELECT {_LONG} AS seq FROM lineitem"))
def kmer_count_long(spark, d):
    key = F.col("l_partkey").cast("string")
    seq = F.concat(*[bases(F.concat(key, F.lit(f"#{i}"))) for i in range(3)])
    return count_kmers(table(spark, d, "lineitem").select(seq.alias("seq")), 55, pregroup=True)


@query("kmer_count_canonical", f"SELECT least(kmer, {RC.format('kmer')}) AS kmer, {CAP.format('count(*)')} AS count FROM ({sql_kmers(7, PART)}) GROUP BY 1")
def kmer_count_canonical(spark, d):
    return count_kmers(part_reads(spark, d), 7, normalize=True)


@query("kmer_forward_only", f"SELECT * FROM ({sql_count(5, PART)}) WHERE kmer < {RC.format('kmer')}")
def kmer_forward_only(spark, d):
    return count_kmers(part_reads(spark, d), 5, forward_only=True)


@query("counted_normalized", f"SELECT least(kmer, {RC.format('kmer')}) AS kmer, {CAP.format('count(*)')} AS count FROM ({sql_kmers(5, PART)}) GROUP BY 1")
def counted_normalized(spark, d):
    return KmerIndex.of_reads(part_reads(spark, d), Params(5, 4)).counted(normalize=True)


@query("reverse_complement", f"SELECT read_id, seq, {RC.format('seq')} AS rc FROM ({PART})")
def reverse_complements(spark, d):
    return part_reads(spark, d).select("read_id", "seq", reverse_complement("seq").alias("rc"))


@query("with_reverse_complements", f"SELECT read_id, seq FROM ({PART}) UNION ALL SELECT read_id, {RC.format('seq')} FROM ({PART})")
def both_strands(spark, d):
    return with_reverse_complements(part_reads(spark, d)).select("read_id", "seq")


@query("orientation", f"SELECT read_id, i AS at, kmer, kmer < {RC.format('kmer')} AS forward FROM ({sql_kmers(5, PART, 'read_id')})")
def orientation(spark, d):
    return kmers(part_reads(spark, d), 5, "seq", "read_id").select("read_id", F.col("at").cast("long").alias("at"), "kmer", is_forward("kmer").alias("forward"))


DIRTY_PART = f"SELECT p_partkey AS read_id, {sql_bases('p_partkey', DIRTY)} AS raw FROM part"
RUNS = "SELECT {0}, unnest(regexp_extract_all(replace(upper(raw), 'U', 'T'), '[ACGT]+')) AS seq FROM ({1})"


@query("fragments_valid", RUNS.format("read_id", DIRTY_PART))
def fragments_valid(spark, d):
    return fragments(part_reads(spark, d, DIRTY)).select("read_id", "seq")


@query(
    "fragments_location",
    f"""WITH raw AS ({DIRTY_PART}), s AS (SELECT read_id, replace(upper(raw), 'U', 'T') AS t FROM raw),
    c AS (SELECT read_id, t, unnest(range(1, length(t) + 1)) AS i FROM s),
    v AS (SELECT read_id, t, i, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS g FROM c WHERE substr(t, CAST(i AS INT), 1) <> 'N')
    SELECT read_id, min(i) AS location, substr(min(t), CAST(min(i) AS INT), CAST(count(*) AS INT)) AS seq FROM v GROUP BY read_id, g""",
)
def fragments_location(spark, d):
    reads = part_reads(spark, d, DIRTY).withColumn("location", F.lit(1).cast("long"))
    return fragments(reads, "seq", "location").select("read_id", "location", "seq")


@query("kmer_count_dirty", sql_count(KM, RUNS.format("1 AS one", DIRTY_PART)))
def kmer_count_dirty(spark, d):
    return count_kmers(part_reads(spark, d, DIRTY), KM)


@query("kmer_count_ambiguous", sql_count(5, f"SELECT raw AS seq FROM ({DIRTY_PART})"))
def kmer_count_ambiguous(spark, d):
    """Sequences as they are, invalid bases and lower case included."""
    return count_kmers(part_reads(spark, d, DIRTY), 5, clean=False)


@query("kmer_count_text", sql_count(3, RUNS.format("1 AS one", "SELECT text AS raw FROM (SELECT regexp_replace(text, '[\\r\\n]', '', 'g') AS text FROM documents)")))
def kmer_count_text(spark, d):
    return count_kmers(table(spark, d, "documents").select(F.col("text").alias("seq")), 3)


# --- filters, maps, summaries ---------------------------------------------------------------------


@query("filter_min", f"SELECT * FROM ({sql_index()}) WHERE count >= 2")
def filter_min(spark, d):
    return index(spark, d).filter_min(2).df


@query("filter_max", f"SELECT * FROM ({sql_index()}) WHERE count <= 30")
def filter_max(spark, d):
    return index(spark, d).filter_max(30).df


@query("filter_range", f"SELECT * FROM ({sql_index()}) WHERE count BETWEEN 20 AND 35")
def filter_range(spark, d):
    return index(spark, d).filter_counts(20, 35).df


@query("map_counts", f"SELECT kmer, CAST(count // 10 AS INTEGER) AS count FROM ({sql_index()}) WHERE count // 10 <> 0")
def map_counts(spark, d):
    return index(spark, d).map_counts(lambda c: F.floor(c / 10)).df


@query("map_counts_batched", f"SELECT kmer, CAST(count % 7 AS INTEGER) AS count FROM ({sql_index()}) WHERE count % 7 <> 0")
def map_counts_batched(spark, d):
    def rest(c: pd.Series) -> pd.Series:
        return c % 7

    return index(spark, d).map_counts_batched(rest).df


@query("negate_counts", f"SELECT kmer, CAST(-count AS INTEGER) AS count FROM ({sql_index()})")
def negate_counts(spark, d):
    return index(spark, d).negate().df


@query("histogram", f"SELECT count AS abundance, count(*) AS count FROM ({sql_index()}) GROUP BY 1")
def histogram(spark, d):
    return index(spark, d).histogram()


STATS = "SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS \"totalAbundance\", count(*) AS \"distinctKmers\", CAST(coalesce(sum(CASE WHEN count = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS \"uniqueKmers\", CAST(coalesce(max(count), 0) AS BIGINT) AS \"maxAbundance\" FROM ({0})"


@query("index_stats", STATS.format(sql_index()))
def index_stats(spark, d):
    return index(spark, d).stats()


@query("index_stats_range", STATS.format(f"SELECT * FROM ({sql_index()}) WHERE count BETWEEN 20 AND 35"))
def index_stats_range(spark, d):
    return index(spark, d).stats(20, 35)


@query("top_kmers", f"SELECT * FROM ({sql_index()}) ORDER BY count DESC, kmer LIMIT 10")
def top_kmers(spark, d):
    return index(spark, d).top(10)


# --- algebra ---------------------------------------------------------------------------------------

IA, IB, IC, IN = (sql_index(x) for x in (A, B, C, N))
FULL = "SELECT * FROM (SELECT kmer, CAST(least({0}, 2147483647) AS INTEGER) AS count FROM (SELECT kmer, x.count AS a, y.count AS b FROM ({1}) x {3} JOIN ({2}) y USING (kmer))) WHERE count > 0"
RULE_SQL = {"sum": "CAST(a AS BIGINT) + b", "max": "greatest(a, b)", "min": "least(a, b)", "left": "a", "right": "b", "counters_subtract": "a - b"}


def sql_union(rule: str, a: str, b: str) -> str:
    return FULL.format(f"CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE {RULE_SQL[rule]} END", a, b, "FULL OUTER")


def sql_intersect(rule: str, a: str, b: str) -> str:
    return FULL.format(RULE_SQL[rule], a, b, "INNER")


def sql_subtract(a: str, b: str) -> str:
    return FULL.format("a - coalesce(b, 0)", a, b, "LEFT")


def _pair(spark, d):
    return index(spark, d, A), index(spark, d, B)


def _binary(name: str, op: str, rule: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, d):
        a, b = _pair(spark, d)
        return getattr(a, op)(b, rule).df


for _rule in ("sum", "max", "min", "left", "right"):
    _binary(f"union_{_rule}", "union", _rule, sql_union(_rule, IA, IB))
for _rule in RULE_SQL:
    _binary(f"intersect_{_rule}", "intersect", _rule, sql_intersect(_rule, IA, IB))
_binary("subtract_counters", "subtract", "counters_subtract", sql_subtract(IA, IB))
_binary("subtract_kmers", "subtract", "kmers_subtract", f"SELECT * FROM ({IA}) WHERE kmer NOT IN (SELECT kmer FROM ({IB}))")


@query("self_union_max", IA)
def self_union_max(spark, d):
    a = index(spark, d, A)
    return a.union(a, "max").df


@query("self_intersect_max", IA)
def self_intersect_max(spark, d):
    a = index(spark, d, A)
    return a.intersect(a, "max").df


@query("union_many_sum", sql_union("sum", sql_union("sum", IA, IB), IC))
def union_many_sum(spark, d):
    a, b = _pair(spark, d)
    return a.union_many([b, index(spark, d, C)]).df


@query("intersect_many_min", sql_intersect("min", sql_intersect("min", IA, IB), IN))
def intersect_many_min(spark, d):
    a, b = _pair(spark, d)
    return a.intersect_many([b, index(spark, d, N)]).df


@query("subtract_many_counters", sql_subtract(sql_subtract(IA, IB), IC))
def subtract_many_counters(spark, d):
    a, b = _pair(spark, d)
    return a.subtract_many([b, index(spark, d, C)]).df


@query("chain_filter_union_union", sql_union("sum", sql_union("sum", f"SELECT * FROM ({IA}) WHERE count >= 8", IB), IN))
def chain_filter_union_union(spark, d):
    a, b = _pair(spark, d)
    return a.filter_min(8).union(b).union(index(spark, d, N)).df


@query("empty_union", IA)
def empty_union(spark, d):
    a = index(spark, d, A)
    return KmerIndex.empty(spark, a.params).union(a).df


@query("lookup_sequences", f"SELECT * FROM ({sql_index()}) WHERE kmer IN (SELECT kmer FROM ({sql_kmers(K, 'SELECT ' + sql_bases('x') + ' AS seq FROM (VALUES (1), (2), (3)) t(x)')}))")
def lookup_sequences(spark, d):
    import hashlib

    names = str.maketrans(HEX, CLEAN)
    return index(spark, d).lookup([hashlib.md5(str(x).encode()).hexdigest().translate(names) for x in (1, 2, 3)]).df


@query("lookup_index", f"SELECT * FROM ({IA}) WHERE kmer IN (SELECT kmer FROM ({IB}))")
def lookup_index(spark, d):
    a, b = _pair(spark, d)
    return a.lookup(b).df


# --- minimizers ------------------------------------------------------------------------------------

MASK = 0x5A
ENC = "+".join(f"(instr('ACGT', substr({{0}}, {i + 1}, 1)) - 1) * {4 ** (M - 1 - i)}" for i in range(M))
LOW = "CASE WHEN instr({0}, 'AA') > 1 OR starts_with({0}, 'AAA') OR starts_with({0}, 'ACA') THEN '1' ELSE '0' END"
RANKS = {
    "lexicographic": "mmer",
    "signature": LOW.format("mmer") + " || mmer",
    "random_xor": f"lpad(CAST(xor(CAST({ENC.format('mmer')} AS INTEGER), {MASK}) AS VARCHAR), 9, '0')",
    "given": "lpad(CAST(rank AS VARCHAR), 9, '0')",
    "frequency": "lpad(CAST(rank AS VARCHAR), 9, '0')",
    "shuffled": "lpad(CAST(rank AS VARCHAR), 9, '0')",
}
ALL_MOTIFS = "SELECT a.x || b.x || c.x || d.x AS motif FROM (VALUES ('A'),('C'),('G'),('T')) a(x), (VALUES ('A'),('C'),('G'),('T')) b(x), (VALUES ('A'),('C'),('G'),('T')) c(x), (VALUES ('A'),('C'),('G'),('T')) d(x)"
MOTIF_COUNTS = f"SELECT kmer AS motif, count(*) AS count FROM ({sql_kmers(M, PART)}) GROUP BY 1"
TABLES = {
    "given": f"SELECT motif, row_number() OVER (ORDER BY reverse(motif)) - 1 AS rank FROM ({ALL_MOTIFS})",
    "shuffled": f"SELECT motif, xor(CAST({ENC.format('motif')} AS INTEGER), {MASK}) AS rank FROM ({ALL_MOTIFS})",
    "frequency": f"SELECT motif, row_number() OVER (ORDER BY coalesce(count, 0), motif) - 1 AS rank FROM ({ALL_MOTIFS}) LEFT JOIN ({MOTIF_COUNTS}) USING (motif)",
}


def sql_supermers(kind: str, k: int = KM) -> str:
    ranked = f"({TABLES[kind]})" if kind in TABLES else None
    join = f" LEFT JOIN {ranked} t ON t.motif = mm.mmer" if ranked else ""
    return f"""WITH mm AS (SELECT read_id, seq, j, substr(seq, CAST(j AS INT), {M}) AS mmer FROM (SELECT *, unnest(range(1, length(seq) - {M} + 2)) AS j FROM ({PART}))),
    w AS (SELECT read_id, seq, j, min({RANKS[kind]} || '#' || lpad(CAST(j AS VARCHAR), 5, '0')) OVER (PARTITION BY read_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {k - M} FOLLOWING) AS best FROM mm{join}),
    g AS (SELECT read_id, any_value(seq) AS seq, CAST(right(best, 5) AS INTEGER) AS p, min(j) AS a, max(j) AS z FROM w WHERE j <= length(seq) - {k} + 1 GROUP BY read_id, best)
    SELECT read_id, substr(seq, p, {M}) AS minimizer, CAST(p - 1 AS INTEGER) AS minimizer_start, CAST(a - 1 AS INTEGER) AS start, substr(seq, CAST(a AS INT), CAST(z - a + {k} AS INT)) AS supermer FROM g"""


def ordering(spark, d, kind: str) -> Ordering:
    if kind == "random_xor":
        return Ordering(M, "random", MASK)
    if kind == "given":
        motifs = minimizer.all_motifs(spark, M).select("motif")
        return Ordering(M, "table", table=minimizer.given(numbered(motifs, [F.reverse("motif")], "line")))
    if kind == "frequency":
        return Ordering(M, "table", table=minimizer.frequency_table(part_reads(spark, d), minimizer.all_motifs(spark, M), M))
    return Ordering(M, kind)


def _supermers(kind: str) -> None:
    @query(f"minimizer_{kind}", sql_supermers(kind))
    def run(spark, d):
        return minimizer.supermers(part_reads(spark, d), KM, ordering(spark, d, kind))


for _kind in [x for x in RANKS if x != "shuffled"]:
    _supermers(_kind)


@query("supermers", f"SELECT minimizer, supermer, count(*) AS n FROM ({sql_supermers('frequency')}) GROUP BY 1, 2")
def supermers(spark, d):
    return minimizer.supermers(part_reads(spark, d), KM, ordering(spark, d, "frequency")).groupBy("minimizer", "supermer").agg(F.count("*").alias("n"))


@query(
    "supermers_located",
    f"WITH s AS ({sql_supermers('lexicographic')}), t AS (SELECT title, CAST(row_number() OVER (ORDER BY title) AS INTEGER) AS seq_id FROM (SELECT DISTINCT p_name AS title FROM part)) SELECT seq_id, CAST(start + 1 AS BIGINT) AS location, minimizer, supermer FROM s JOIN part ON p_partkey = read_id JOIN t ON t.title = p_name",
)
def supermers_located(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("read_id"), F.col("p_name").alias("header"))
    reads = part_reads(spark, d).join(names, "read_id").withColumn("location", F.lit(1).cast("long"))
    ids = numbered(titles(reads), [F.col("title")], "seq_id", start=1).select("title", F.col("seq_id").cast("int").alias("seq_id"))
    return minimizer.supermers_located(reads, KM, Ordering(M), ids).select("seq_id", "location", "minimizer", "supermer")


@query("motif_counts", MOTIF_COUNTS)
def motif_counts(spark, d):
    return minimizer.motif_counts(part_reads(spark, d), M)


@query("motif_frequency_table", f"SELECT motif, row_number() OVER (ORDER BY coalesce(count, 0), motif) - 1 AS rank, CAST(coalesce(count, 0) AS BIGINT) AS count, coalesce(count, 0) >= 5000000 AS large FROM ({ALL_MOTIFS}) LEFT JOIN ({MOTIF_COUNTS}) USING (motif)")
def motif_frequency_table(spark, d):
    return minimizer.frequency_table(part_reads(spark, d), minimizer.all_motifs(spark, M), M)


BUCKETS = f"""SELECT minimizer, count(DISTINCT s) AS "superKmers", CAST(sum(c) AS BIGINT) AS "totalAbundance", count(*) AS "distinctKmers", CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "uniqueKmers", max(c) AS "maxAbundance" FROM (
    SELECT minimizer, kmer, count(*) AS c, arg_min(read_id * 100000 + start, read_id * 100000 + start + i) AS s FROM (
        SELECT read_id, minimizer, start, i, substr(supermer, CAST(i AS INT), {KM}) AS kmer FROM (SELECT *, unnest(range(1, length(supermer) - {KM} + 2)) AS i FROM ({sql_supermers('lexicographic')}))
    ) GROUP BY minimizer, kmer) GROUP BY minimizer"""


def _stats(spark, d):
    return minimizer.bucket_stats(part_reads(spark, d), KM, Ordering(M))


@query("bucket_stats", BUCKETS)
def bucket_stats(spark, d):
    return _stats(spark, d)


@query("bucket_stats_all_bins", "SELECT motif AS minimizer, " + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in minimizer.STATS) + f" FROM ({ALL_MOTIFS}) LEFT JOIN ({BUCKETS}) ON minimizer = motif")
def bucket_stats_all_bins(spark, d):
    return minimizer.all_bins(_stats(spark, d), minimizer.all_motifs(spark, M))


@query("bin_distribution", f'SELECT CAST(ceil("totalAbundance" / 100.0) * 100 AS BIGINT) AS abundance, count(*) AS bins FROM ({BUCKETS}) GROUP BY 1')
def bin_distribution(spark, d):
    return minimizer.bin_distribution(_stats(spark, d))


_LONG_STATS = " UNION ALL ".join(f"SELECT '{c}' AS statistic, \"{c}\" AS v FROM s" for c in minimizer.STATS)


@query("stats_report", f'WITH s AS ({BUCKETS}) SELECT statistic, count(*) AS bins, CAST(sum(v) AS BIGINT) AS total, avg(v) AS mean, CAST(min(v) AS BIGINT) AS least, CAST(max(v) AS BIGINT) AS most, stddev(v) AS spread FROM ({_LONG_STATS}) GROUP BY statistic')
def stats_report(spark, d):
    return minimizer.stats_report(_stats(spark, d))


_MORE = sql_kmers(KM, PART, "read_id")


@query("merged_stats", f'SELECT minimizer, CAST(2 * "superKmers" AS BIGINT) AS "superKmers", CAST(2 * "totalAbundance" AS BIGINT) AS "totalAbundance", CAST(2 * "distinctKmers" AS BIGINT) AS "distinctKmers", CAST(2 * "uniqueKmers" AS BIGINT) AS "uniqueKmers", "maxAbundance" FROM ({BUCKETS})')
def merged_stats(spark, d):
    return minimizer.merge_stats(_stats(spark, d), _stats(spark, d))


@query("equal_counts", f'SELECT minimizer, "uniqueKmers" = "distinctKmers" AND "maxAbundance" = 1 AS equal FROM ({BUCKETS})')
def equal_counts(spark, d):
    """A bin equals itself without the k-mers that repeat where none does."""
    a = _stats(spark, d)
    return minimizer.equal_counts(a, minimizer.bucket_stats(part_reads(spark, d), KM, Ordering(M), high=1))


@query(
    "motif_report",
    f"""WITH c AS ({MOTIF_COUNTS}), t AS (SELECT 'top' AS "end", * FROM c ORDER BY count DESC, motif LIMIT 5), b AS (SELECT 'bottom' AS "end", * FROM c ORDER BY count, motif LIMIT 5)
    SELECT "end", motif, count, count / (SELECT sum(count) FROM c) AS share FROM (SELECT * FROM t UNION ALL SELECT * FROM b)""",
)
def motif_report(spark, d):
    return minimizer.motif_report(minimizer.frequency_table(part_reads(spark, d), minimizer.all_motifs(spark, M), M))


_BINS = """SELECT minimizer, CAST(sum(count) AS BIGINT) AS "totalAbundance", count(*) AS "distinctKmers", CAST(sum(CASE WHEN count = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "uniqueKmers", CAST(max(count) AS BIGINT) AS "maxAbundance" FROM ({0}) GROUP BY minimizer"""
# the least m-mer of each k-mer under the order of reversed motifs
_GIVEN_OF = f"SELECT kmer, count, reverse(list_min(list_transform(range(1, {K} - {M} + 2), lambda i: reverse(substr(kmer, CAST(i AS INT), {M}))))) AS minimizer FROM ({{0}})"


@query("stored_index_bins", _BINS.format(_GIVEN_OF.format(IA)))
def stored_index_bins(spark, d):
    """An ordering by table goes with the stored index, whose bins are then known without reads."""
    path = _scratch(spark)
    index(spark, d).change_ordering(ordering(spark, d, "given")).repartition(4).write(path)
    return KmerIndex.read(spark, path).bins()


@query("reindexed_bins", _BINS.format(_GIVEN_OF.format(IA).replace("reverse(substr(kmer, CAST(i AS INT), 4))", "substr(kmer, CAST(i AS INT), 4)").replace("reverse(list_min", "(list_min")))
def reindexed_bins(spark, d):
    stored = index(spark, d).change_ordering(ordering(spark, d, "given"))
    return stored.change_ordering(Ordering(M)).bins()


@query("compatible_index", sql_union("sum", IA, IB))
def compatible_index(spark, d):
    """New reads, counted with the parameters and ordering of an index that is there, join it."""
    a = index(spark, d).change_ordering(ordering(spark, d, "given"))
    more = a.of_more_reads(table(spark, d, "orders").select(bases(F.col("o_custkey").cast("long") * 2).alias("seq")), pregroup=True)
    return a.empty_like().union(a).union(more).df


@query("minimizer_priority", sql_supermers("given"))
def minimizer_priority(spark, d):
    """The order of reversed motifs as a function instead of a table."""
    return minimizer.supermers(part_reads(spark, d), KM, Ordering(M, "priority", priority=F.reverse))


@query("minimizer_subset_lexicographic", sql_supermers("lexicographic"))
def minimizer_subset(spark, d):
    return minimizer.supermers(part_reads(spark, d), KM, minimizer.make_ordering(spark, "lexicographic", M, minimizer.all_motifs(spark, M)))


TABLES["bundled"] = "SELECT motif, row_number() OVER (ORDER BY motif) - 1 AS rank FROM (VALUES " + ", ".join(f"('{''.join('ACGT'[c >> 2 * (M - 1 - j) & 3] for j in range(M))}')" for c in hitting_set(KM, M)) + ") v(motif)"
# motifs outside the set come last
RANKS["bundled"] = "coalesce(lpad(CAST(rank AS VARCHAR), 9, '0'), 'outside')"


@query("minimizer_bundled", sql_supermers("bundled"))
def minimizer_bundled(spark, d):
    """Motifs of a universal hitting set, of which every k-mer holds one."""
    return minimizer.supermers(part_reads(spark, d), KM, Ordering(M, "table", table=bundled(spark, KM, M)))


# --- super-mers as the unit of the shuffle and of storage -------------------------------------------


@query("kmer_count_supermers", sql_index())
def kmer_count_supermers(spark, d):
    return count_by_supermers(line_reads(spark, d), K)


@query("kmer_count_supermers_k55", sql_count(55, f"SELECT {_LONG} AS seq FROM lineitem"))
def kmer_count_supermers_k55(spark, d):
    key = F.col("l_partkey").cast("string")
    seq = F.concat(*[bases(F.concat(key, F.lit(f"#{i}"))) for i in range(3)])
    return count_by_supermers(table(spark, d, "lineitem").select(seq.alias("seq")), 55, Ordering(9, "signature"))


@query("kmer_count_supermers_canonical", f"SELECT least(kmer, {RC.format('kmer')}) AS kmer, {CAP.format('count(*)')} AS count FROM ({sql_kmers(9, RUNS.format('1 AS one', DIRTY_PART))}) GROUP BY 1")
def kmer_count_supermers_canonical(spark, d):
    """Every minimizer that a full sample calls hot for two parts is split."""
    reads = part_reads(spark, d, DIRTY)
    return count_by_supermers(reads, 9, Ordering(2), seq="seq", normalize=True, hot=list(range(8)))


def super_index(spark, d, source: tuple[str, str, int] = A, like: SupermerIndex | None = None, by: Ordering | None = None, buckets: int = 8) -> SupermerIndex:
    """Written and read again."""
    name, key, times = source
    reads, path = keys(spark, d, name, key).select(bases(F.col(key).cast("long") * times).alias("seq")), _scratch(spark)
    made = like.of_more_reads(reads) if like else SupermerIndex.of_reads(reads, K, by or Ordering(8), buckets=buckets)
    made.write(path)
    return SupermerIndex.read(spark, path)


@query("supermer_index_roundtrip", IA)
def supermer_index_roundtrip(spark, d):
    return super_index(spark, d).counted()


def _super_pair(spark, d):
    a = super_index(spark, d)
    return a, super_index(spark, d, B, a)


def _super_binary(name: str, op: str, rule: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, d):
        a, b = _super_pair(spark, d)
        return getattr(a, op)(b, rule).counted()


_super_binary("supermer_index_union_sum", "union", "sum", sql_union("sum", IA, IB))
_super_binary("supermer_index_union_max", "union", "max", sql_union("max", IA, IB))
_super_binary("supermer_index_intersect_min", "intersect", "min", sql_intersect("min", IA, IB))
_super_binary("supermer_index_subtract_counters", "subtract", "counters_subtract", sql_subtract(IA, IB))
_super_binary("supermer_index_subtract_kmers", "subtract", "kmers_subtract", f"SELECT * FROM ({IA}) WHERE kmer NOT IN (SELECT kmer FROM ({IB}))")


@query("supermer_index_filter", f"SELECT * FROM ({IA}) WHERE count BETWEEN 20 AND 35")
def supermer_index_filter(spark, d):
    return super_index(spark, d).filter_counts(20, 35).counted()


@query("supermer_index_lookup", f"SELECT * FROM ({IA}) WHERE kmer IN (SELECT kmer FROM ({IN}))")
def supermer_index_lookup(spark, d):
    return super_index(spark, d).lookup(keys(spark, d, "customer", "c_custkey").select(bases(F.col("c_custkey").cast("long") * 4).alias("seq"))).counted()


@query("supermer_reindex_signature", IA)
def supermer_reindex_signature(spark, d):
    """Cut anew by another ordering, written, and read again."""
    path = _scratch(spark)
    super_index(spark, d).change_ordering(Ordering(7, "signature")).repartition(5).write(path)
    return SupermerIndex.read(spark, path).counted()


@query("supermer_reindex_given_union", sql_union("sum", IA, IB))
def supermer_reindex_given(spark, d):
    """An index by a table of motifs takes in one by another ordering."""
    a = super_index(spark, d, by=ordering(spark, d, "given"))
    return a.union(super_index(spark, d, B)).counted()


# a k-mer's place is in the super-mer that sorts first of those that hold it
STORED_BINS = f"""SELECT minimizer, count(DISTINCT home) AS "superKmers", CAST(sum(c) AS BIGINT) AS "totalAbundance", count(*) AS "distinctKmers", CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "uniqueKmers", max(c) AS "maxAbundance" FROM (
    SELECT minimizer, kmer, count(*) AS c, min(supermer) AS home FROM (
        SELECT minimizer, supermer, substr(supermer, CAST(i AS INT), {KM}) AS kmer FROM (SELECT *, unnest(range(1, length(supermer) - {KM} + 2)) AS i FROM ({{0}}))
    ) GROUP BY minimizer, kmer) GROUP BY minimizer"""


def _super_bins(kind: str) -> None:
    @query(f"supermer_index_bins_{kind}", STORED_BINS.format(sql_supermers(kind)))
    def run(spark, d):
        """The five statistics of every bin from the stored index, without reads."""
        path = _scratch(spark)
        SupermerIndex.of_reads(part_reads(spark, d), KM, ordering(spark, d, kind), buckets=4).write(path)
        return SupermerIndex.read(spark, path).bins()


for _kind in ("lexicographic", "given"):
    _super_bins(_kind)


@query("method_choice", f"SELECT coalesce(bool_or(coalesce(count, 0) >= 5000000), false) AS pregroup, CAST(coalesce(sum(count), 0) AS BIGINT) AS kmers FROM ({ALL_MOTIFS}) LEFT JOIN ({MOTIF_COUNTS}) USING (motif)")
def method_choice(spark, d):
    """What the automatic method decides by."""
    table_ = minimizer.frequency_table(part_reads(spark, d), minimizer.all_motifs(spark, M), M)
    return table_.agg(F.lit(minimizer.pays_to_pregroup(table_)).alias("pregroup"), F.sum("count").alias("kmers"))


@query("cached_index", f"SELECT a.*, b.n FROM ({STATS.format(sql_index())}) a, (SELECT count(*) AS n FROM ({sql_index()}) WHERE count >= 2) b")
def cached_index(spark, d):
    """Two results of an index that is counted once."""
    held = index(spark, d).cache()
    n = held.filter_min(2).df.count()
    out = held.stats().select("*", F.lit(n).cast("long").alias("n"))
    rows = out.collect()
    held.unpersist()
    return spark.createDataFrame(rows, out.schema)


# --- files -----------------------------------------------------------------------------------------


def _scratch(spark) -> str:
    return scratch_path(spark, "roundtrip")


@query("sequence_titles", "SELECT DISTINCT p_name AS title FROM part")
def sequence_titles(spark, d):
    path = _scratch(spark)
    reads = table(spark, d, "part").select(F.concat(F.lit(">"), "p_name", F.lit("\n"), bases(F.col("p_partkey"))).alias("value"))
    reads.write.text(path)
    return sequences.sequence_titles(spark, [path])


@query("fasta_roundtrip", f"SELECT CAST(read_id AS VARCHAR) AS header, seq FROM ({PART})")
def fasta_roundtrip(spark, d):
    path = _scratch(spark)
    # records of several lines, with a longer title
    lines = F.concat(F.lit(">"), "read_id", F.lit(" of part\n"), F.substring("seq", 1, 20), F.lit("\n"), F.substring("seq", 21, 100))
    part_reads(spark, d).select(lines.alias("value")).write.text(path)
    return sequences.read_sequences(spark, [path]).select("header", F.col("nucleotides").alias("seq"))


@query("fastq_roundtrip", f"SELECT CAST(read_id AS VARCHAR) AS header, seq FROM ({PART})")
def fastq_roundtrip(spark, d):
    path = _scratch(spark) + ".fastq"
    lines = F.concat(F.lit("@"), "read_id", F.lit(" of part\n"), "seq", F.lit("\n+\n@"), F.repeat(F.lit("I"), 31))
    part_reads(spark, d).select(lines.alias("value")).write.text(path)
    return sequences.read_sequences(spark, [path]).select("header", F.col("nucleotides").alias("seq"))


#: Reads of one long sequence, and bases of one task.
FAI_LINES, FAI_SPLIT = 2000, 50_000
LONG_SQL = f"SELECT string_agg(seq, '' ORDER BY read_id) AS seq FROM ({PART}) GROUP BY read_id // {FAI_LINES}"


def _long_fasta(spark, d) -> str:
    """The whole part table as long sequences, a read for each line, whole sequences in each file."""
    path = _scratch(spark) + ".fasta"
    lines = part_reads(spark, d).withColumn("chr", F.floor(F.col("read_id") / FAI_LINES))
    heads = lines.groupBy("chr").agg(F.count("*").alias("n"))
    heads_out = heads.select("chr", F.lit(-1).cast("long").alias("read_id"), F.concat(F.lit(">chr"), "chr", F.lit(" long")).alias("value"))
    lines.select("chr", "read_id", F.col("seq").alias("value")).unionByName(heads_out).repartition("chr").sortWithinPartitions("chr", "read_id").select("value").write.text(path)
    return path


@query("fai_roundtrip", sql_count(K, LONG_SQL))
def fai_roundtrip(spark, d):
    """Files are indexed, and read by the ranges of bases that the index gives."""
    path = _long_fasta(spark, d)
    sequences.write_fai(spark, path, FAI_SPLIT)
    return count_kmers(sequences.read_long_fasta(spark, path, K, FAI_SPLIT).select(F.col("nucleotides").alias("seq")), K)


@query(
    "fai_index",
    f"SELECT 'chr' || (read_id // {FAI_LINES}) AS id, CAST(sum(length(seq)) AS BIGINT) AS length, CAST(32 AS INTEGER) AS \"bpsPerLine\", CAST(33 AS INTEGER) AS \"bytesPerLine\" FROM ({PART}) GROUP BY read_id // {FAI_LINES}",
)
def fai_index(spark, d):
    return sequences.build_fai(spark, _long_fasta(spark, d), FAI_SPLIT).select("id", "length", "bpsPerLine", "bytesPerLine")


@query("long_fasta_pieces", sql_count(K, LONG_SQL))
def long_fasta_pieces(spark, d):
    """The same without an index: ranges of bytes find their titles and places themselves."""
    return count_kmers(sequences.read_fasta_pieces(spark, _long_fasta(spark, d), K, FAI_SPLIT).select(F.col("nucleotides").alias("seq")), K)


@query("fastq_splits", f"SELECT CAST(read_id AS VARCHAR) AS header, seq FROM ({PART})")
def fastq_splits(spark, d):
    """Records cut by many ranges, quality lines of which every other starts with @ and some with +."""
    path = _scratch(spark) + ".fastq"
    quality = F.concat(F.element_at(F.array(F.lit("@"), F.lit("+"), F.lit("@"), F.lit("I")), (F.col("read_id") % 4 + 1).cast("int")), F.repeat(F.lit("@"), 31))
    lines = F.concat(F.lit("@"), "read_id", F.lit(" of part\n"), "seq", F.lit("\n+\n"), quality)
    part_reads(spark, d).select(lines.alias("value")).write.text(path)
    return sequences.read_fastq(spark, path, split=3000).select("header", F.col("nucleotides").alias("seq"))


@query("fasta_counts_roundtrip", f"SELECT kmer, count FROM ({IA})")
def fasta_counts_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_fasta_counts(index(spark, d, A).df, path)
    back = sequences.read_fasta(spark, f"{path}_counts")
    return back.select(F.col("nucleotides").alias("kmer"), F.col("title").cast("int").alias("count"))


@query("tsv_roundtrip", f"SELECT kmer, count FROM ({IA})")
def tsv_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_tsv(index(spark, d, A).df, path)
    return spark.read.schema("kmer string, count int").option("sep", "\t").csv(f"{path}_counts")


def _stored(spark, d, source: tuple[str, str, int], buckets: int = 8) -> KmerIndex:
    path = _scratch(spark)
    index(spark, d, source).repartition(buckets).write(path)
    return KmerIndex.read(spark, path)


@query("counts_only_roundtrip", f"SELECT CAST(count AS VARCHAR) AS value, count(*) AS n FROM ({IA}) GROUP BY 1")
def counts_only_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_tsv(index(spark, d).df, path, with_kmers=False)
    return spark.read.text(f"{path}_counts").groupBy("value").agg(F.count("*").alias("n"))


@query("histogram_roundtrip", f"SELECT count AS abundance, count(*) AS count FROM ({IA}) GROUP BY 1")
def histogram_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_histogram(index(spark, d).histogram(), path)
    return spark.read.schema("abundance int, count long").option("sep", "\t").csv(f"{path}_counts")


@query("bucket_stats_roundtrip", BUCKETS)
def bucket_stats_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_bucket_stats(_stats(spark, d), path)
    return spark.read.schema("minimizer string, " + ", ".join(f"{c} long" for c in minimizer.STATS)).option("sep", "\t").csv(f"{path}_bucketStats")


@query("supermers_roundtrip", f"SELECT minimizer, supermer FROM ({sql_supermers('signature')})")
def supermers_roundtrip(spark, d):
    path = _scratch(spark)
    sinks.write_supermers(minimizer.supermers(part_reads(spark, d), KM, ordering(spark, d, "signature")), path)
    return spark.read.schema("minimizer string, supermer string").option("sep", "\t").csv(f"{path}_superkmers")


@query("frequencies_roundtrip", f"SELECT motif, row_number() OVER (ORDER BY coalesce(count, 0), motif) - 1 AS line FROM ({ALL_MOTIFS}) LEFT JOIN ({MOTIF_COUNTS}) USING (motif)")
def frequencies_roundtrip(spark, d):
    """A sampled ordering is written, found again as the best file of its folder, and read in file order."""
    path = _scratch(spark)
    sinks.write_frequencies(minimizer.frequency_table(part_reads(spark, d), minimizer.all_motifs(spark, M), M), f"{path}/a")
    move(spark, f"{path}/a_minimizers_sample.txt", f"{path}/minimizers_{KM}_{M}.txt")
    return sequences.read_motifs(spark, sequences.best_motif_file(spark, path, K, M)).select("motif", "line")


@query("mixed_files", f"SELECT CAST(read_id AS VARCHAR) AS header, seq FROM ({PART}) UNION ALL SELECT 'q' || read_id, seq FROM ({PART})")
def mixed_files(spark, d):
    """A FASTA and a FASTQ file, named in a list file."""
    path, reads = _scratch(spark), part_reads(spark, d)
    reads.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value")).write.text(f"{path}.fasta")
    reads.select(F.concat(F.lit("@q"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), 32)).alias("value")).write.text(f"{path}.fastq")
    spark.createDataFrame([(f"{path}.fasta",), (f"{path}.fastq",)], "value string").coalesce(1).write.text(f"{path}.list")
    return sequences.read_sequences(spark, [f"@{path}.list"]).select("header", F.col("nucleotides").alias("seq"))


@query("minimizer_shuffled_set", sql_supermers("shuffled"))
def minimizer_shuffled_set(spark, d):
    return minimizer.supermers(part_reads(spark, d), KM, minimizer.make_ordering(spark, "random", M, minimizer.all_motifs(spark, M), seed=MASK))


@query("index_roundtrip", sql_union("sum", IA, IB))
def index_roundtrip(spark, d):
    return _stored(spark, d, A).union(_stored(spark, d, B)).df


@query("reindex", sql_union("sum", IA, IB))
def reindex(spark, d):
    a, b = _pair(spark, d)
    return a.change_ordering(Ordering(5, "signature")).union(b).df


@query("repartition", IA)
def repartition(spark, d):
    return index(spark, d, A).repartition(5).df


def _files(spark, d) -> tuple[str, str, str]:
    """part's reads as FASTA and orders' as FASTQ, and a folder for results."""
    path = _scratch(spark)
    part_reads(spark, d).select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value")).write.text(f"{path}/a.fasta")
    orders = keys(spark, d, "orders", "o_custkey").select(bases(F.col("o_custkey").cast("long") * 2).alias("seq"))
    orders.select(F.concat(F.lit("@r\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), 32)).alias("value")).write.text(f"{path}/b.fastq")
    return f"{path}/a.fasta", f"{path}/b.fastq", path


FILE_A, FILE_B = sql_count(K, PART), sql_count(K, f"SELECT {sql_bases('CAST(o_custkey AS BIGINT) * 2')} AS seq FROM orders")


def _cli(spark, *words: str) -> str:
    from ..cli import run

    return run(spark, ["-m", "5", "-p", "4", "--sample", "1", *words])


@query("cli_store_union", sql_union("sum", FILE_A, FILE_B))
def cli_store_union(spark, d):
    """A stored index takes in a file that is counted on the fly."""
    a, b, out = _files(spark, d)
    _cli(spark, "-k", str(K), "store", a, "-o", f"{out}/A")
    _cli(spark, "union", "-i", f"{out}/A", b, "-o", f"{out}/C")
    return KmerIndex.read(spark, f"{out}/C").df


@query("cli_supermers_intersect", sql_intersect("max", FILE_A, FILE_B))
def cli_supermers_intersect(spark, d):
    a, b, out = _files(spark, d)
    _cli(spark, "-k", str(K), "store", a, "-o", f"{out}/A", "--supermers")
    _cli(spark, "intersect", "-i", f"{out}/A", b, "-r", "max", "-o", f"{out}/C")
    return SupermerIndex.read(spark, f"{out}/C").counted()


@query("cli_sample", f"SELECT motif, CAST(coalesce(count, 0) AS BIGINT) AS count FROM ({ALL_MOTIFS}) LEFT JOIN ({MOTIF_COUNTS}) USING (motif)")
def cli_sample(spark, d):
    a, _, out = _files(spark, d)
    from ..cli import run

    path = run(spark, ["-k", str(K), "-m", str(M), "--sample", "1", "sample", a, "-o", f"{out}/freq"])
    return spark.read.schema("motif string, count long").csv(path)


@query("cli_subtract_reindex", f"SELECT * FROM ({sql_subtract(FILE_A, FILE_B)}) WHERE count <= 30")
def cli_subtract_reindex(spark, d):
    """Counts of a list of files less those of another, bounded, under another ordering."""
    a, b, out = _files(spark, d)
    spark.createDataFrame([(a,)], "value string").coalesce(1).write.text(f"{out}/list")
    _cli(spark, "-k", str(K), "store", f"@{out}/list", "-o", f"{out}/A")
    _cli(spark, "-k", str(K), "store", b, "-o", f"{out}/B")
    _cli(spark, "subtract", "-i", f"{out}/A", "-i", f"{out}/B", "-o", f"{out}/C", "--max", "30")
    _cli(spark, "--ordering", "signature", "reindex", "-i", f"{out}/C", "-o", f"{out}/D", "--changeMinimizers")
    return KmerIndex.read(spark, f"{out}/D").df


@query("sample_hash", f"SELECT * FROM ({sql_index()}) WHERE CAST('0x' || substr(md5(kmer), 1, 8) AS BIGINT) % 1000000 < 250000")
def sample_hash(spark, d):
    return index(spark, d).sample_hash(0.25).df


@query("sample_random", None)
def sample_random(spark, d):
    return index(spark, d).sample(0.25, seed=7).df


@query("sampled_reads_index", f"SELECT kmer, {CAP.format('count(*)')} AS count FROM ({sql_kmers(K, PART)}) WHERE CAST('0x' || substr(md5(seq), 1, 8) AS BIGINT) % 1000000 < 500000 GROUP BY kmer".replace(f"FROM ({sql_kmers(K, PART)})", f"FROM ({sql_kmers(K, PART, 'seq')})"))
def sampled_reads_index(spark, d):
    from ..operators.index import fraction_of

    return count_kmers(part_reads(spark, d).where(fraction_of(F.col("seq"), 0.5)), K)


@query("udtf_kmers", sql_count(K, PART))
def udtf_kmers(spark, d):
    from ..functions.udtf import register

    register(spark)
    part_reads(spark, d).createOrReplaceTempView("strandlake_reads")
    return spark.sql(f"SELECT kmer, CAST(count(*) AS INT) AS count FROM strandlake_reads r, LATERAL kmers(r.seq, {K}) GROUP BY kmer")


@query("udtf_supermers", f"SELECT minimizer, start, supermer FROM ({sql_supermers('lexicographic')})")
def udtf_supermers(spark, d):
    from ..functions.udtf import register

    register(spark)
    part_reads(spark, d).createOrReplaceTempView("strandlake_reads")
    return spark.sql(f"SELECT s.minimizer, s.start, s.supermer FROM strandlake_reads r, LATERAL supermers(r.seq, {KM}, {M}) s")


@query("stream_counts", f"SELECT kmer, count(*) AS count FROM ({sql_kmers(K, PART)}) GROUP BY kmer")
def stream_counts(spark, d):
    """Batches of a stream are counted and written one by one, and summed up when they are read."""
    from ..streaming.counting import count_into, counts_at

    schema = table(spark, d, "part").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(d).select("p_partkey")
    path = _scratch(spark)
    count_into(dealt(rows, "p_partkey", table(spark, d, "part")).select(bases(F.col("p_partkey")).alias("seq")), K, f"{path}/counts", f"{path}/progress").awaitTermination()
    return counts_at(spark, f"{path}/counts").select("kmer", F.col("count").cast("long").alias("count"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in QUERIES.items() if q.sql}
