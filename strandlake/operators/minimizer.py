"""Minimizer orderings, super-mers and bin statistics.

A k-mer's minimizer is its m-mer of least rank, the leftmost of equals. Super-mers are formed within
each read, without a shuffle, as the leftmost least place never moves back along a read: in
Arrow batches (``packed``), where ranks are a formula of the m-mer's code or looked up by it. A
priority, which is any column function, is computed in the row by Spark; a table of more than
``TABLE_MOTIFS`` motifs is joined to the m-mers.

Defined results: null and too short sequences give nothing; rows that are alike in key and
sequence are reads of their own, each with all its super-mers; ties of rank go to the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import decode, encode
from . import packed
from .numbering import numbered
from .sequence import LARGE_BUCKET, fragments, kmers

#: Motifs up to which a table's ranks go to every task, as a vector by code up to ``DENSE_M`` bases: 8 MB.
TABLE_MOTIFS, DENSE_M = 1 << 20, 10


@dataclass(frozen=True)
class Ordering:
    """kind: lexicographic, signature, random (by ``mask``), table (``motif``, ``rank``) or priority.

    A priority is any function of an m-mer's column to a column that m-mers are compared by.
    """

    m: int
    kind: str = "lexicographic"
    mask: int = 0
    table: DataFrame | None = field(default=None, compare=False)
    priority: Callable[[Column], Column] | None = field(default=None, compare=False)
    _ranks: list = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self):
        most = 15 if self.kind == "table" else 31
        if not 1 <= self.m <= most:
            raise ValueError(f"m must be from 1 to {most}")
        if (self.kind == "table") != (self.table is not None):
            raise ValueError("a table ordering needs a table, others take none")
        if (self.kind == "priority") != (self.priority is not None):
            raise ValueError("a priority ordering needs a function, others take none")

    def rank(self, mmer: Column) -> Column:
        """What m-mers are compared by (not for tables)."""
        if self.kind == "lexicographic":
            return F.struct(mmer.alias("r"))
        if self.kind == "signature":
            return F.struct(is_low(mmer).cast("int").alias("low"), mmer.alias("r"))
        if self.priority is not None:
            return F.struct(self.priority(mmer).alias("r"))
        if self.kind == "random":
            return F.struct(encode(mmer).bitwiseXOR(F.lit(self.mask)).alias("r"))
        raise ValueError(f"no such ordering: {self.kind}")

    def packed(self) -> packed.Ranks | None:
        """Ranks by code, for tasks; None for a priority and for tables of more than ``TABLE_MOTIFS``. A table is read once."""
        if self.kind == "priority":
            return None
        if not self._ranks:
            self._ranks.append(self._table_ranks() if self.table is not None else packed.Ranks(self.m, self.kind, self.mask))
        return self._ranks[0]

    def _table_ranks(self) -> packed.Ranks | None:
        rows = self.table.where(F.length("motif") == self.m).select(encode("motif").alias("code"), "rank").limit(TABLE_MOTIFS + 1).toArrow()
        if len(rows) > TABLE_MOTIFS:
            return None
        code, given = rows["code"].to_numpy(), rows["rank"].to_numpy()
        rank = np.unique(given, return_inverse=True)[1].ravel().astype(np.int64)
        if self.m <= DENSE_M:
            dense = np.full(4**self.m, -1, np.int64)
            dense[code] = rank
            return packed.Ranks(self.m, "table", ranks=dense)
        order = np.argsort(code)
        return packed.Ranks(self.m, "table", codes=code[order], ranks=rank[order])


def is_low(mmer: Column) -> Column:
    """Signature ordering: the first AA is past the start, or the motif starts with AAA or ACA."""
    return (F.instr(mmer, "AA") > 1) | mmer.startswith("AAA") | mmer.startswith("ACA")


def check(k: int, m: int) -> None:
    if not 1 <= m < k:
        raise ValueError("m must be at least 1 and less than k")


def all_motifs(spark, m: int) -> DataFrame:
    """All 4^m motifs with their lexicographic rank."""
    return spark.range(4**m).select(decode(F.col("id"), m).alias("motif"), F.col("id").alias("rank"))


def given(motifs: DataFrame) -> DataFrame:
    """``motif, rank`` from ``motif, line``: file order is the rank."""
    return motifs.select("motif", F.col("line").cast("long").alias("rank"))


def motif_counts(reads: DataFrame, m: int, motifs: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """``motif, count``: valid m-mers of the reads, of the set ``motifs(motif)`` if given."""
    each = kmers(fragments(reads.select(seq), seq), m, seq).select(F.col("kmer").alias("motif"))
    counted = each.groupBy("motif").agg(F.count("*").alias("count"))
    return counted if motifs is None else counted.join(motifs.select("motif"), "motif", "left_semi")


def frequency_table(reads: DataFrame, motifs: DataFrame, m: int, fraction: float = 1.0, seed: int = 0, seq: str = "seq") -> DataFrame:
    """``motif, rank, count, large``: rare motifs first, then by prior rank; unseen ones count 0. Ranks are dense from 0 for every m."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    if not 1 <= m <= 15:
        raise ValueError("m must be from 1 to 15")
    sampled = reads if fraction == 1 else reads.sample(fraction, seed)
    counted = motifs.join(motif_counts(sampled, m, None, seq), "motif", "left").select("motif", F.col("rank").alias("prior"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    placed = numbered(counted, [F.col("count"), F.col("prior")], "rank")
    return placed.select("motif", "rank", "count", (F.col("count") / fraction >= LARGE_BUCKET).alias("large"))


def shuffled(motifs: DataFrame, seed: int) -> DataFrame:
    """Random order of a set of motifs: ranks by ``rank XOR seed``."""
    return motifs.select("motif", F.col("rank").bitwiseXOR(F.lit(seed)).cast("long").alias("rank"))


def _ranked(reads: DataFrame, ordering: Ordering, seq: str, key: str) -> DataFrame:
    """``key, seq, mm`` of every row: array of (rank, place) of all m-mers, in order of place."""
    m = ordering.m
    long = reads.where(F.length(seq) >= m)
    places = F.sequence(F.lit(1), F.length(seq) - (m - 1))
    if ordering.kind != "table":
        mm = F.transform(places, lambda j: F.struct(ordering.rank(F.substring(F.col(seq), j, F.lit(m))).alias("rank"), j.alias("p")))
        return long.select(key, seq, mm.alias("mm"))
    # numbered first, so that rows that are alike stay apart
    rows = long.select(key, seq, F.monotonically_increasing_id().alias("__row"))
    each = rows.select("__row", key, seq, F.explode(places).alias("p")).withColumn("motif", F.substring(F.col(seq), F.col("p"), F.lit(m)))
    joined = each.join(ordering.table.select("motif", "rank"), "motif", "left")
    # m-mers outside the set rank after all others; whether one is chosen is checked by the caller
    return joined.groupBy("__row", key, seq).agg(F.array_sort(F.collect_list(F.struct("p", F.struct(F.col("rank").isNull().alias("out"), "rank").alias("rank")))).alias("ps")).select(
        key, seq, F.transform("ps", lambda x: F.struct(x["rank"].alias("rank"), x["p"].alias("p"))).alias("mm")
    )


def _window_least(mm: str, width: int) -> Column:
    """The least of every ``width`` consecutive entries: stretches of 1, 2, 4, ... are put together, so each entry is looked at once for each doubling."""

    def overlaid(column: Column, shift: int) -> Column:
        # both sides are cut to the places that have a partner
        return F.transform(F.array(column), lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - shift), F.slice(a, F.lit(shift + 1), F.size(a) - shift), lambda x, y: F.least(x, y)))[0]

    out, span = F.col(mm), 1
    while 2 * span <= width:
        out, span = overlaid(out, span), 2 * span
    return overlaid(out, width - span) if span < width else out


def _supermers_in_columns(reads: DataFrame, k: int, ordering: Ordering, seq: str, key: str, strict: bool) -> DataFrame:
    ranked = _ranked(reads.where(F.length(seq) >= k), ordering, seq, key)
    least = _window_least("mm", k - ordering.m + 1)
    # one entry per run: the place of the minimizer, where the run starts and how many k-mers it has
    starts = lambda mins: F.filter(F.sequence(F.lit(1), F.size(mins)), lambda i: (i == 1) | (F.element_at(mins, i)["p"] != F.element_at(mins, F.greatest(i - 1, F.lit(1)))["p"]))

    def run(mins: Column) -> Column:
        def entry(at: Column) -> Column:
            return F.transform(
                at["a"],
                lambda s, i: F.struct(
                    F.element_at(mins, s)["p"].alias("p"), F.element_at(mins, s)["rank"].alias("rank"), s.alias("first"), (F.coalesce(F.get(at["a"], i + 1), F.size(mins) + 1) - s).alias("n")
                ),
            )

        return F.transform(F.array(F.struct(starts(mins).alias("a"))), entry)[0]

    each = ranked.select(key, seq, F.explode(F.transform(F.array(least), run)[0]).alias("s"))
    if ordering.kind == "table":
        outside = F.col("s.rank.out")
        if strict:
            each = each.where(F.when(outside, F.raise_error(F.lit("a k-mer has no minimizer of the given set")).isNotNull()).otherwise(True))
        else:
            each = each.where(~outside)
    return each.select(
        key,
        F.substring(F.col(seq), F.col("s.p"), F.lit(ordering.m)).alias("minimizer"),
        (F.col("s.p") - 1).cast("int").alias("minimizer_start"),
        (F.col("s.first") - 1).cast("int").alias("start"),
        F.substring(F.col(seq), F.col("s.first").cast("int"), F.col("s.n") + (k - 1)).alias("supermer"),
    )


def supermers(reads: DataFrame, k: int, ordering: Ordering, seq: str = "seq", key: str = "read_id", strict: bool = True) -> DataFrame:
    """``key, minimizer, minimizer_start, start, supermer`` (places from 0) of reads with valid bases only.

    A super-mer is a maximal run of k-mers with the same minimizer occurrence. strict: a k-mer
    without any m-mer of the table is an error; else its k-mers are left out.
    """
    check(k, ordering.m)
    ranks = ordering.packed()
    if ranks is None:
        return _supermers_in_columns(reads, k, ordering, seq, key, strict)
    long = reads.where(F.length(seq) >= k).select(key, seq)
    known, m = reads.sparkSession.sparkContext.broadcast(ranks), ordering.m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in packed.slices(b, 1)):
            code, length = packed.bases_of(batch.column(1))
            s = packed.cut(code, length, k, known.value)
            keep = packed.checked(s.outside, strict)
            read, place, motif, n = s.read[keep], s.place[keep], s.motif[keep], s.n[keep]
            head = (np.cumsum(length) - length)[read]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(read)),
                    packed.strings(code, motif, np.full(len(motif), m)),
                    pa.array((motif - head).astype(np.int32)),
                    pa.array((place - head).astype(np.int32)),
                    packed.strings(code, place, n + k - 1),
                ],
                [key, "minimizer", "minimizer_start", "start", "supermer"],
            )

    fields = [T.StructField(key, long.schema[0].dataType)] + [T.StructField(c, t) for c, t in (("minimizer", T.StringType()), ("minimizer_start", T.IntegerType()), ("start", T.IntegerType()), ("supermer", T.StringType()))]
    return long.mapInArrow(run, T.StructType(fields))


def supermers_located(reads: DataFrame, k: int, ordering: Ordering, titles: DataFrame, seq: str = "seq", key: str = "read_id", header: str = "header", location: str = "location") -> DataFrame:
    """Super-mers with the sequence id of ``titles(title, seq_id)`` and the absolute 1-based place."""
    where = reads.select(key, F.col(header).alias("title"), location).join(titles, "title")
    found = supermers(reads, k, ordering, seq, key).join(where, key)
    return found.select("seq_id", (F.col(location) + F.col("start")).alias("location"), "minimizer", "supermer")


def bucket_stats(reads: DataFrame, k: int, ordering: Ordering, low: int = 1, high: int | None = None, seq: str = "seq", key: str = "read_id") -> DataFrame:
    """Per minimizer: ``minimizer, superKmers, totalAbundance, distinctKmers, uniqueKmers, maxAbundance``.

    superKmers counts super-mers that hold the first occurrence (by read, then place) of at
    least one distinct k-mer. low and high bound the counts of the k-mers that take part.
    """
    found = supermers(reads, k, ordering, seq, key)
    each = found.select(key, "minimizer", "start", "supermer", F.explode(F.sequence(F.lit(1), F.length("supermer") - (k - 1))).alias("i"))
    each = each.select("minimizer", F.substring(F.col("supermer"), F.col("i"), F.lit(k)).alias("kmer"), F.struct(key, (F.col("start") + F.col("i")).alias("at"), "start").alias("where"))
    per_kmer = each.groupBy("minimizer", "kmer").agg(F.count("*").alias("c"), F.min("where").alias("first")).where(F.col("c") >= low)
    if high is not None:
        per_kmer = per_kmer.where(F.col("c") <= high)
    return per_kmer.groupBy("minimizer").agg(
        F.countDistinct(f"first.{key}", "first.start").alias("superKmers"),
        F.sum("c").alias("totalAbundance"),
        F.count("*").alias("distinctKmers"),
        F.sum((F.col("c") == 1).cast("long")).alias("uniqueKmers"),
        F.max("c").alias("maxAbundance"),
    )


STATS = ("superKmers", "totalAbundance", "distinctKmers", "uniqueKmers", "maxAbundance")


def all_bins(stats: DataFrame, motifs: DataFrame) -> DataFrame:
    """The statistics of every motif, empty bins with zeros."""
    listed = motifs.select(F.col("motif").alias("minimizer")).join(stats, "minimizer", "left")
    return listed.select("minimizer", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in STATS])


def bin_distribution(stats: DataFrame, width: int = 100) -> DataFrame:
    """How many bins have a total abundance up to each multiple of ``width``."""
    return stats.groupBy((F.ceil(F.col("totalAbundance") / width) * width).cast("long").alias("abundance")).agg(F.count("*").alias("bins"))


def stats_report(stats: DataFrame) -> DataFrame:
    """Over the bins that are not empty: ``statistic, bins, total, mean, least, most, spread``, a row for each of ``STATS``."""
    full = stats.where("totalAbundance > 0")
    pairs = ", ".join(f"'{c}', {c}" for c in STATS)
    long = full.selectExpr(f"stack({len(STATS)}, {pairs}) AS (statistic, v)")
    return long.groupBy("statistic").agg(
        F.count("*").alias("bins"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.stddev("v").alias("spread")
    )


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of bins that were gathered apart (of different k-mers): sums, and the largest of maxima."""
    every = parts[0].select("minimizer", *STATS)
    for p in parts[1:]:
        every = every.unionAll(p.select("minimizer", *STATS))
    return every.groupBy("minimizer").agg(*[F.sum(c).cast("long").alias(c) for c in STATS[:-1]], F.max(STATS[-1]).cast("long").alias(STATS[-1]))


def equal_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``minimizer, equal``: whether both have the same k-mer statistics of a bin (super-mers may be cut otherwise)."""
    named = b.select(F.col("minimizer").alias("other"), *[F.col(c).alias(f"b_{c}") for c in STATS[1:]])
    same = F.lit(True)
    for c in STATS[1:]:
        same = same & F.coalesce(c, F.lit(0)).eqNullSafe(F.coalesce(f"b_{c}", F.lit(0)))
    return a.join(named, F.col("minimizer") == F.col("other"), "full").select(F.coalesce("minimizer", "other").alias("minimizer"), same.alias("equal"))


def motif_report(table: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most and the ``n`` least frequent motifs that were seen: ``end, motif, count, share``."""
    seen = table.where("count > 0")
    total = F.broadcast(seen.agg(F.sum("count").alias("total")))
    ends = seen.orderBy(F.desc("count"), "motif").limit(n).withColumn("end", F.lit("top")).unionByName(seen.orderBy("count", "motif").limit(n).withColumn("end", F.lit("bottom")))
    # the total is one row
    return ends.crossJoin(total).select("end", "motif", "count", (F.col("count") / F.col("total")).alias("share"))


def pays_to_pregroup(table: DataFrame) -> bool:
    """Whether a frequency table expects a motif with so many k-mers that equal sequences are better counted first."""
    return bool(table.where("large").take(1))


def make_ordering(spark, kind: str, m: int, motifs: DataFrame | None = None, reads: DataFrame | None = None, fraction: float = 0.01, seed: int = 0, priority=None) -> Ordering:
    """An ordering by its name, over the set ``motifs(motif, rank)`` or all motifs.

    frequency is sampled from ``reads(seq)``; random draws its mask from the seed; given takes
    the set's own ranks; priority takes a function.
    """
    if kind == "priority":
        return Ordering(m, "priority", priority=priority)
    if kind == "frequency":
        if reads is None:
            raise ValueError("a frequency ordering is sampled from reads")
        return Ordering(m, "table", table=frequency_table(reads, motifs if motifs is not None else all_motifs(spark, m), m, fraction, seed))
    if kind == "given":
        if motifs is None:
            raise ValueError("a given ordering needs a set of motifs")
        return Ordering(m, "table", table=motifs)
    if kind == "random":
        if motifs is not None:
            return Ordering(m, "table", table=shuffled(motifs, seed))
        # a mask of 2m bits from the seed
        return Ordering(m, "random", (seed * 0x9E3779B97F4A7C15 >> 7) % 4**m)
    if motifs is not None and kind == "lexicographic":
        return Ordering(m, "table", table=motifs.select("motif", encode(F.col("motif")).alias("rank")))
    return Ordering(m, kind)


def kmer_bins(counts: DataFrame, k: int, ordering: Ordering) -> DataFrame:
    """Per minimizer of counted k-mers: ``minimizer, totalAbundance, distinctKmers, uniqueKmers, maxAbundance``."""
    each = supermers(counts.select(F.struct("kmer", "count").alias("of"), "kmer"), k, ordering, "kmer", "of").select("minimizer", F.col("of.count").alias("c"))
    return each.groupBy("minimizer").agg(
        F.sum("c").cast("long").alias("totalAbundance"), F.count("*").alias("distinctKmers"), F.sum((F.col("c") == 1).cast("long")).alias("uniqueKmers"), F.max("c").cast("long").alias("maxAbundance")
    )
