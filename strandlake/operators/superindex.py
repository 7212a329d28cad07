"""Counting and storing k-mers as super-mers, routed by minimizer.

A super-mer is packed two bits a base and sent whole, so a shuffle moves a few bytes for each
k-mer instead of a string; its k-mers are cut where it arrives. All copies of a k-mer have the
same minimizer, so they meet there without another shuffle. A minimizer that holds too many
k-mers is split by a second digit (``packed.cut``) that depends on the k-mer alone too.

``SupermerIndex`` keeps the counts in this form: a row for each distinct super-mer, with a count for every
place of a k-mer in it. A k-mer is counted in one place only, when built that of the super-mer that sorts
first of all that hold it; elsewhere its count is 0. Stored buckets are by minimizer and digit, so that indexes
with the same ordering, hot minimizers and buckets are combined without a shuffle; of others, super-mers are
dealt out anew, not k-mers. The number of buckets asked for is the least one: it grows with the reads.

Defined results: null and too short sequences give nothing; invalid bases break sequences; equal
sequences each count; counts saturate at 2**31 - 1; super-mers without any counted k-mer are not kept; an
index without k-mers has no rows; extra columns of the reads are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import MAX_COUNT, capped, decode, is_forward
from . import packed
from .minimizer import Ordering, check
from .sequence import fragments, with_reverse_complements

#: Second digits that a hot minimizer's k-mers are dealt to.
DIGITS = 4096
#: Super-mers that a task sums up before they are sent: about 40 bytes each.
HOLD = 1 << 20
#: Share of the reads that hot minimizers are looked for in; it decides where k-mers are counted, not how.
SAMPLE = 0.01
#: K-mers, repeated ones too, up to which a bucket is meant to hold: some 100 bytes each where they are sorted.
BUCKET = 1 << 23
PACKED = "minimizer long, digit int, size int, words array<long>, weight long"
INDEX = "minimizer long, digit int, size int, words array<long>, counts array<int>"


def _ranks(ordering: Ordering) -> packed.Ranks:
    ranks = ordering.packed()
    if ranks is None:
        raise ValueError("super-mers are routed by codes: a priority, or a table this large, must be given as a formula or a smaller table")
    return ranks


def packed_supermers(reads: DataFrame, k: int, ordering: Ordering, seq: str = "seq", hot: list[int] | None = None, digits: int = DIGITS, hold: int = HOLD, strict: bool = True) -> DataFrame:
    """``minimizer`` (code), ``digit, size, words, weight``: the super-mers of reads with valid bases only, equal ones of a task summed up."""
    check(k, ordering.m)
    spark = reads.sparkSession
    known = spark.sparkContext.broadcast((_ranks(ordering), np.array(hot or [], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, many = known.value
        yield from packed.packed_batches(batches, k, ranks, many, digits, hold, strict)

    return reads.where(F.length(seq) >= k).select(seq).mapInArrow(run, PACKED)


def hot_minimizers(reads: DataFrame, k: int, ordering: Ordering, seq: str = "seq", fraction: float = SAMPLE, seed: int = 0, parts: int | None = None, normalize: bool = False) -> list[int]:
    """Codes of the minimizers that hold more than half of a part's share of a sample's k-mers: at most twice as many as there are parts."""
    parts = parts or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = prepared(reads.sample(fraction, seed) if fraction < 1 else reads, k, seq, normalize)
    n = (F.col("size") - (k - 1)) * F.col("weight")
    # the sum over all comes as one more row, without a minimizer
    per = packed_supermers(some, k, ordering, seq, strict=False).rollup("minimizer").agg(F.sum(n).alias("n"))
    rows = per.where("n is not null").orderBy(F.desc("n"), F.col("minimizer").asc_nulls_first()).limit(2 * parts + 1).collect()
    total = next((r["n"] for r in rows if r["minimizer"] is None), 0)
    return sorted(r["minimizer"] for r in rows if r["minimizer"] is not None and r["n"] > total / (2 * parts))


def buckets_for(reads: DataFrame, k: int, least: int, seq: str = "seq", normalize: bool = False, fraction: float = SAMPLE, seed: int = 0) -> int:
    """``least``, or as many as hold up to about ``BUCKET`` k-mers each, by a sample of the reads."""
    some = prepared(reads.sample(fraction, seed) if fraction < 1 else reads, k, seq, normalize)
    n = some.where(F.length(seq) >= k).agg(F.sum(F.length(seq) - (k - 1))).first()[0] or 0
    return max(least, -(-int(n / fraction) // BUCKET))


def routed(supers: DataFrame, parts: int | None = None) -> DataFrame:
    """Equal super-mers summed up, in the part of their minimizer and digit."""
    where = [F.col("minimizer"), F.col("digit")]
    dealt = supers.repartition(parts, *where) if parts else supers.repartition(*where)
    return dealt.groupBy("minimizer", "digit", "size", "words").agg(F.sum("weight").alias("weight"))


def bases(words: Column, size: Column) -> Column:
    return F.substring(F.array_join(F.transform(words, lambda w: decode(w, packed.WORD)), ""), F.lit(1), size)


def cut_kmers(supers: DataFrame, k: int, *keep: str) -> DataFrame:
    """Every k-mer of every super-mer: ``minimizer, digit, place`` (from 0), ``kmer`` and the columns to keep."""
    others = [c for c in keep if c not in ("minimizer", "digit")]
    one = supers.select("minimizer", "digit", *others, F.col("size").alias("__n"), bases(F.col("words"), F.col("size")).alias("__seq"))
    # places by the size: a filter that Spark adds on what is exploded then needs no bases
    each = one.select("minimizer", "digit", *others, "__seq", F.explode(F.sequence(F.lit(0), F.col("__n") - k)).alias("place"))
    return each.select("minimizer", "digit", *others, "place", F.substring(F.col("__seq"), F.col("place") + 1, F.lit(k)).alias("kmer"))


def prepared(reads: DataFrame, k: int, seq: str, normalize: bool) -> DataFrame:
    if normalize and k % 2 == 0:
        raise ValueError("normalizing needs an odd k")
    one = fragments(reads.select(seq), seq)
    return with_reverse_complements(one, seq) if normalize else one


def count_by_supermers(reads: DataFrame, k: int, ordering: Ordering | None = None, *, seq: str = "seq", normalize: bool = False, hot: list[int] | None = None, parts: int | None = None) -> DataFrame:
    """``kmer, count`` as ``count_kmers`` has it: super-mers go through the one shuffle, k-mers are cut and summed after it.

    normalize: both strands are routed and forward k-mers kept, which counts a k-mer and its
    reverse complement as one. hot: minimizers to be split; None: those found in a sample.
    """
    ordering = ordering or Ordering(min(10, k - 1))
    one = prepared(reads, k, seq, normalize)
    if hot is None:
        hot = hot_minimizers(reads, k, ordering, seq, parts=parts, normalize=normalize)
    supers = routed(packed_supermers(one, k, ordering, seq, hot), parts)
    each = cut_kmers(supers, k, "weight")
    if normalize:
        each = each.where(is_forward("kmer"))
    # all copies of a k-mer are in this part already
    return each.groupBy("minimizer", "digit", "kmer").agg(capped(F.sum("weight")).alias("count")).select("kmer", "count")


def _homes(rows: DataFrame) -> DataFrame:
    """The index of ``minimizer, digit, home`` (words, size, place) and ``count``: a row for each super-mer that is some k-mer's home."""
    per = rows.groupBy("minimizer", "digit", F.col("home.words").alias("words"), F.col("home.size").alias("size"), "n").agg(F.map_from_entries(F.collect_list(F.struct("home.place", "count"))).alias("at"))
    counts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.element_at("at", i), F.lit(0)))
    return per.select("minimizer", "digit", "size", "words", counts.alias("counts"))


def _once(df: DataFrame) -> DataFrame:
    """Rows of the same super-mer, whose counted places differ, as one."""
    one = df.groupBy("minimizer", "digit", "size", "words").agg(F.collect_list("counts").alias("all"))
    zero = lambda x: F.transform(F.element_at(x, 1), lambda _: F.lit(0))
    added = F.aggregate("all", zero(F.col("all")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return one.select("minimizer", "digit", "size", "words", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(added).alias("counts"))


@dataclass(frozen=True)
class SuperParams:
    k: int
    m: int
    ordering: str = "lexicographic"
    mask: int = 0
    normalize: bool = False
    buckets: int = 200
    hot: tuple[int, ...] = ()
    digits: int = DIGITS
    version: int = 2


class SupermerIndex:
    """Counted k-mers on their super-mers; each operation gives a new index over a lazy plan."""

    def __init__(self, df: DataFrame, params: SuperParams, motifs: DataFrame | None = None):
        self.df, self.params, self.motifs = df.select("minimizer", "digit", "size", "words", "counts"), params, motifs

    # --- building -------------------------------------------------------------------------

    @classmethod
    def of_reads(cls, reads: DataFrame, k: int, ordering: Ordering, *, seq: str = "seq", normalize: bool = False, buckets: int = 200, hot: list[int] | None = None) -> SupermerIndex:
        one = prepared(reads, k, seq, normalize)
        buckets = buckets_for(reads, k, buckets, seq, normalize)
        if hot is None:
            hot = hot_minimizers(reads, k, ordering, seq, parts=buckets, normalize=normalize)
        params = SuperParams(k, ordering.m, ordering.kind, ordering.mask, normalize, buckets, tuple(hot))
        return cls(cls._counted_on(one, params, ordering, seq), params, ordering.table)

    @staticmethod
    def _counted_on(one: DataFrame, params: SuperParams, ordering: Ordering, seq: str) -> DataFrame:
        supers = routed(packed_supermers(one, params.k, ordering, seq, list(params.hot), params.digits), params.buckets)
        each = cut_kmers(supers, params.k, "weight", "words", "size")
        if params.normalize:
            each = each.where(is_forward("kmer"))
        home = F.min(F.struct("words", "size", "place")).alias("home")
        per = each.groupBy("minimizer", "digit", "kmer").agg(capped(F.sum("weight")).alias("count"), home)
        return _homes(per.withColumn("n", F.col("home.size") - (params.k - 1)))

    @property
    def ordering(self) -> Ordering:
        p = self.params
        return Ordering(p.m, p.ordering, p.mask, self.motifs)

    def of_more_reads(self, reads: DataFrame, seq: str = "seq") -> SupermerIndex:
        """An index of other reads with this one's ordering, hot minimizers and buckets, or more buckets if these reads need them."""
        p = self.params
        p = replace(p, buckets=buckets_for(reads, p.k, p.buckets, seq, p.normalize))
        return SupermerIndex(self._counted_on(prepared(reads, p.k, seq, p.normalize), p, self.ordering, seq), p, self.motifs)

    def _with(self, df: DataFrame) -> SupermerIndex:
        return SupermerIndex(df, self.params, self.motifs)

    # --- results --------------------------------------------------------------------------

    def kmers(self) -> DataFrame:
        """``minimizer, digit, words, size, place, kmer, count`` of every k-mer."""
        each = cut_kmers(self.df, self.params.k, "words", "size", "counts").withColumn("count", F.element_at("counts", F.col("place") + 1))
        return each.where("count <> 0").drop("counts")

    def counted(self) -> DataFrame:
        return self.kmers().select("kmer", "count")

    def bins(self, low: int = 1, high: int | None = None) -> DataFrame:
        """As ``bucket_stats``, from the stored counts: ``minimizer`` (motif) and its five statistics; superKmers are super-mers that hold a counted k-mer."""
        some = F.filter("counts", lambda c: (c >= low) & (c <= (MAX_COUNT if high is None else high)))
        rows = _once(self.df).select("minimizer", some.alias("cs")).where(F.size("cs") > 0)
        stats = rows.groupBy("minimizer").agg(
            F.count("*").alias("superKmers"),
            F.sum(F.aggregate("cs", F.lit(0).cast("long"), lambda a, c: a + c)).alias("totalAbundance"),
            F.sum(F.size("cs")).cast("long").alias("distinctKmers"),
            F.sum(F.size(F.filter("cs", lambda c: c == 1))).cast("long").alias("uniqueKmers"),
            F.max(F.array_max("cs")).cast("long").alias("maxAbundance"),
        )
        return stats.withColumn("minimizer", decode(F.col("minimizer"), self.params.m))

    def supermers(self) -> DataFrame:
        """``minimizer, supermer, counts`` as text and arrays."""
        return self.df.select(decode(F.col("minimizer"), self.params.m).alias("minimizer"), bases(F.col("words"), F.col("size")).alias("supermer"), "counts")

    # --- filters, maps and algebra -----------------------------------------------------------

    def map_counts(self, f) -> SupermerIndex:
        """``f`` maps a count's column to a column; k-mers mapped to 0 go, and super-mers left without any. No k-mer is cut out."""
        df = self.df.withColumn("counts", F.transform("counts", lambda c: F.when(c != 0, f(c).cast("int")).otherwise(F.lit(0))))
        return self._with(df.where(F.exists("counts", lambda c: c != 0)))

    def filter_counts(self, low: int | None = None, high: int | None = None) -> SupermerIndex:
        least, most = low or 1, MAX_COUNT if high is None else high
        return self.map_counts(lambda c: F.when((c >= least) & (c <= most), c).otherwise(F.lit(0)))

    def fits(self, other: SupermerIndex) -> bool:
        """Whether both route k-mers alike, so that they are combined where they are."""
        a, b = self.params, other.params
        alike = (a.m, a.ordering, a.mask, a.hot, a.digits) == (b.m, b.ordering, b.mask, b.hot, b.digits)
        if alike and a.ordering == "table" and self.motifs is not other.motifs:
            mine, theirs = self.motifs.select("motif", "rank"), other.motifs.select("motif", "rank")
            alike = not mine.exceptAll(theirs).take(1) and not theirs.exceptAll(mine).take(1)
        return alike

    def _fitting(self, other: SupermerIndex) -> tuple[SupermerIndex, SupermerIndex]:
        """Both, routed alike and in as many buckets as the one with more has."""
        if (self.params.k, self.params.normalize) != (other.params.k, other.params.normalize):
            raise ValueError(f"indexes don't fit: {self.params} and {other.params}")
        # buckets by minimizer and digit serve joins on these and the k-mer
        self.df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        n, alike = max(self.params.buckets, other.params.buckets), self.fits(other)
        # super-mers are dealt out here: the join would shuffle their k-mers
        mine = self if self.params.buckets == n else self.repartition(n)
        if not alike:
            other = other.change_ordering(self.ordering, list(self.params.hot), self.params.digits)
        return mine, other if alike and other.params.buckets == n else other.repartition(n)

    def _joined(self, other: SupermerIndex, how: str, count: Column) -> DataFrame:
        """This index's k-mers with ``count`` of the columns a and b (longs), where that is above 0, at their places here."""
        mine = self.kmers().withColumn("a", F.col("count").cast("long")).drop("count")
        # packed files say little about how many k-mers they hold, so neither side is ever broadcast
        theirs = other.kmers().select("minimizer", "digit", "kmer", F.col("count").cast("long").alias("b")).hint("merge")
        both = mine.join(theirs, ["minimizer", "digit", "kmer"], how).withColumn("count", capped(count)).where("count > 0")
        return _homes(both.select("minimizer", "digit", F.struct("words", "size", "place").alias("home"), "count", (F.col("size") - (self.params.k - 1)).alias("n")))

    def union(self, other: SupermerIndex, rule: str = "sum") -> SupermerIndex:
        """K-mers of this index at their places with the counts of the rule, and those that only the other has at theirs."""
        a, b = F.col("a"), F.col("b")
        rules = {"sum": a + F.coalesce(b, F.lit(0)), "max": F.greatest(a, b), "min": F.least(a, b), "left": a, "right": F.coalesce(b, a)}
        if rule not in rules:
            raise ValueError(f"no such rule for a union: {rule}")
        mine, other = self._fitting(other)
        return mine._with(mine._joined(other, "left", rules[rule]).unionAll(other._without(mine)))

    def _without(self, other: SupermerIndex) -> DataFrame:
        left = self.kmers().join(other.kmers().select("minimizer", "digit", "kmer").hint("merge"), ["minimizer", "digit", "kmer"], "left_anti")
        return _homes(left.select("minimizer", "digit", F.struct("words", "size", "place").alias("home"), "count", (F.col("size") - (self.params.k - 1)).alias("n")))

    def intersect(self, other: SupermerIndex, rule: str = "min") -> SupermerIndex:
        a, b = F.col("a"), F.col("b")
        rules = {"sum": a + b, "max": F.greatest(a, b), "min": F.least(a, b), "left": a, "right": b, "counters_subtract": a - b}
        if rule not in rules:
            raise ValueError(f"no such rule for an intersection: {rule}")
        mine, other = self._fitting(other)
        return mine._with(mine._joined(other, "inner", rules[rule]))

    def subtract(self, other: SupermerIndex, rule: str = "counters_subtract") -> SupermerIndex:
        if rule not in ("kmers_subtract", "counters_subtract"):
            raise ValueError(f"no such rule for a subtraction: {rule}")
        mine, other = self._fitting(other)
        if rule == "kmers_subtract":
            return mine._with(mine._without(other))
        return mine._with(mine._joined(other, "left", F.col("a") - F.coalesce("b", F.lit(0))))

    def lookup(self, reads: DataFrame, seq: str = "seq") -> SupermerIndex:
        """This index's counts of the k-mers of some sequences."""
        return self.intersect(self.of_more_reads(reads, seq), "left")

    # --- another ordering ------------------------------------------------------------------

    def change_ordering(self, ordering: Ordering, hot: list[int] | None = None, digits: int = DIGITS) -> SupermerIndex:
        """The super-mers cut anew by another ordering, each with its slice of the counts: k-mers are neither cut out nor counted again.

        Parts without a counted k-mer go. Rows are dealt by their new minimizers when the index is written or combined.
        """
        k = self.params.k
        check(k, ordering.m)
        known = self.df.sparkSession.sparkContext.broadcast((_ranks(ordering), np.array(hot or [], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranks, many = known.value
            for batch in batches:
                size = batch.column(0).to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(size)), np.asarray(pa.compute.list_value_length(batch.column(1))))
                code = packed.bases_of_words(batch.column(1).flatten().to_numpy(), owner, size)
                counts = batch.column(2).flatten().to_numpy()
                s = packed.cut(code, size, k, ranks, many, digits)
                keep = packed.checked(s.outside, True)
                if len(s.n):
                    keep &= np.add.reduceat(counts != 0, s.kmer) > 0
                n, length = s.n[keep], s.n[keep] + k - 1
                at = np.arange(int(n.sum())) + np.repeat(s.kmer[keep] - (np.cumsum(n) - n), n)
                slices = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(counts[at].astype(np.int32)))
                words = packed.word_lists(packed.words_of(code, s.place[keep], length), length)
                yield pa.RecordBatch.from_arrays([pa.array(s.minimizer[keep]), pa.array(s.digit[keep]), pa.array(length.astype(np.int32)), words, slices], ["minimizer", "digit", "size", "words", "counts"])

        df = self.df.select("size", "words", "counts").mapInArrow(run, INDEX)
        params = replace(self.params, m=ordering.m, ordering=ordering.kind, mask=ordering.mask, hot=tuple(hot or ()), digits=digits)
        return SupermerIndex(df, params, ordering.table)

    def repartition(self, buckets: int) -> SupermerIndex:
        return SupermerIndex(self.df.repartition(buckets, "minimizer", "digit"), replace(self.params, buckets=buckets), self.motifs)

    # --- storage --------------------------------------------------------------------------

    def write(self, location: str) -> None:
        """Parquet in buckets by minimizer and digit, sorted by them, with parameters and ordering beside it."""
        spark, n = self.df.sparkSession, self.params.buckets
        table = f"supermers_{uuid.uuid4().hex}"
        dealt = _once(self.df.repartition(n, "minimizer", "digit"))
        (dealt.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(n, "minimizer", "digit").sortBy("minimizer", "digit").option("path", location).saveAsTable(table))
        spark.sql(f"DROP TABLE {table}")  # external: the files stay
        spark.createDataFrame([(json.dumps(asdict(self.params)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{location}_params")
        if self.motifs is not None:
            self.motifs.select("motif", "rank").write.mode("overwrite").parquet(f"{location}_motifs")

    @staticmethod
    def is_at(spark: SparkSession, location: str) -> bool:
        """Whether an index of this form is stored there, rather than a flat one."""
        return json.loads(spark.read.text(f"{location}_params").first()[0]).get("version") == 2

    def stats(self) -> DataFrame:
        """One row: ``totalAbundance, distinctKmers, uniqueKmers, maxAbundance``, from the counts by place."""
        bins = self.bins()
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("totalAbundance", "distinctKmers", "uniqueKmers")]
        return bins.agg(*sums, F.coalesce(F.max("maxAbundance"), F.lit(0)).cast("long").alias("maxAbundance"))

    @classmethod
    def read(cls, spark: SparkSession, location: str) -> SupermerIndex:
        found = json.loads(spark.read.text(f"{location}_params").first()[0])
        if found.get("version") != 2:
            raise ValueError(f"no super-mer index: {location}")
        params = SuperParams(**{**found, "hot": tuple(found["hot"])})
        table = f"supermers_{uuid.uuid4().hex}"
        path = location.replace("'", "\\'")

        spark.sql(f"CREATE TABLE {table} ({INDEX}) USING parquet CLUSTERED BY (minimizer, digit) SORTED BY (minimizer, digit) INTO {params.buckets} BUCKETS LOCATION '{path}'")
        df = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the plan holds what it needs
        return cls(df, params, spark.read.parquet(f"{location}_motifs") if params.ordering == "table" else None)
