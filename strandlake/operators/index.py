"""An immutable multiset of counted k-mers: one flat ``(kmer, count)`` relation and its parameters.

Defined results: null counts take no part in filters and statistics; an index without k-mers has statistics
of 0 and an empty histogram; k-mers of equal count come in order of the k-mer in ``top`` and
``bottom``; a written index replaces what is there; extra columns of reads and indexes are not read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import MAX_COUNT, canonical, is_forward
from ..sources.sequences import read_sequences
from . import algebra
from .minimizer import Ordering, bucket_stats, check, kmer_bins, supermers
from .sequence import count_kmers, fragments

SCHEMA = "kmer string, count int"


@dataclass(frozen=True)
class Params:
    k: int
    m: int = 10
    normalize: bool = False
    ordering: str = "lexicographic"
    mask: int = 0
    buckets: int = 200
    version: int = 1

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if self.normalize and self.k % 2 == 0:
            raise ValueError("normalizing needs an odd k")
        if self.k > 1:
            check(self.k, min(self.m, self.k - 1))


def fraction_of(name: Column, fraction: float) -> Column:
    """Whether a string is among a fraction of all strings, by the first 32 bits of its MD5."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(1_000_000)) < int(fraction * 1_000_000)


class KmerIndex:
    """Every operation gives a new index over a lazy plan; nothing is computed before an action."""

    def __init__(self, df: DataFrame, params: Params, motifs: DataFrame | None = None):
        self.df, self.params, self.motifs = df.select("kmer", F.col("count").cast("int").alias("count")), params, motifs

    # --- building -------------------------------------------------------------------------

    @classmethod
    def of_reads(cls, reads: DataFrame, params: Params, seq: str = "seq", pregroup: bool = False) -> KmerIndex:
        return cls(count_kmers(reads, params.k, seq=seq, normalize=params.normalize, pregroup=pregroup), params)

    @classmethod
    def of_sequences(cls, spark: SparkSession, sequences: list[str], params: Params) -> KmerIndex:
        """From strings at hand, without joining the strands."""
        return cls.of_reads(spark.createDataFrame([(s,) for s in sequences], "seq string"), replace(params, normalize=False))

    @classmethod
    def empty(cls, spark: SparkSession, params: Params) -> KmerIndex:
        return cls(spark.createDataFrame([], SCHEMA), params)

    def _with(self, df: DataFrame) -> KmerIndex:
        return KmerIndex(df, self.params, self.motifs)

    def empty_like(self) -> KmerIndex:
        """Without k-mers, with this index's parameters and ordering."""
        return self._with(self.df.sparkSession.createDataFrame([], SCHEMA))

    def of_more_reads(self, reads: DataFrame, seq: str = "seq", pregroup: bool = False) -> KmerIndex:
        """An index of other reads that fits this one: same parameters, same ordering."""
        return self._with(count_kmers(reads, self.params.k, seq=seq, normalize=self.params.normalize, pregroup=pregroup))

    @property
    def ordering(self) -> Ordering:
        """The minimizer ordering that the index was made or stored with."""
        p = self.params
        return Ordering(p.m, p.ordering, p.mask, self.motifs) if p.ordering == "table" else Ordering(p.m, p.ordering, p.mask)

    def bins(self) -> DataFrame:
        """Statistics of each minimizer's k-mers, also of a stored index (super-mers aren't kept)."""
        return kmer_bins(self.df, self.params.k, self.ordering)

    def _checked(self, other: KmerIndex) -> KmerIndex:
        """Indexes fit if they count the same k-mers; orderings don't matter to counts."""
        if (self.params.k, self.params.normalize) != (other.params.k, other.params.normalize):
            raise ValueError(f"indexes don't fit: {self.params} and {other.params}")
        return other

    # --- filters and maps -----------------------------------------------------------------

    def filter_counts(self, low: int | None = None, high: int | None = None) -> KmerIndex:
        df = self.df
        if low is not None and low > 1:
            df = df.where(F.col("count") >= low)
        if high is not None and high < MAX_COUNT:
            df = df.where(F.col("count") <= high)
        return self._with(df)

    def filter_min(self, low: int) -> KmerIndex:
        return self.filter_counts(low=low)

    def filter_max(self, high: int) -> KmerIndex:
        return self.filter_counts(high=high)

    def map_counts(self, f) -> KmerIndex:
        """``f`` maps the count column to a column; k-mers mapped to 0 go."""
        return self._with(self.df.select("kmer", f(F.col("count")).cast("int").alias("count")).where("count <> 0"))

    def map_counts_batched(self, f) -> KmerIndex:
        """As ``map_counts``, for a Python function of a pandas Series (Arrow batches)."""
        return self.map_counts(F.pandas_udf(f, "int"))

    def negate(self) -> KmerIndex:
        return self.map_counts(lambda c: -c)

    def sample(self, fraction: float, seed: int = 0) -> KmerIndex:
        """Each distinct k-mer stays with the given probability."""
        return self._with(self.df.sample(fraction, seed))

    def sample_hash(self, fraction: float) -> KmerIndex:
        """As ``sample``, the same k-mers in every index and run."""
        return self._with(self.df.where(fraction_of(F.col("kmer"), fraction)))

    def forward(self) -> KmerIndex:
        return self._with(self.df.where(is_forward("kmer")))

    # --- algebra --------------------------------------------------------------------------

    def union(self, other: KmerIndex, rule: str = "sum") -> KmerIndex:
        return self._with(algebra.union(self.df, self._checked(other).df, rule))

    def intersect(self, other: KmerIndex, rule: str = "min") -> KmerIndex:
        return self._with(algebra.intersect(self.df, self._checked(other).df, rule))

    def subtract(self, other: KmerIndex, rule: str = "counters_subtract") -> KmerIndex:
        return self._with(algebra.subtract(self.df, self._checked(other).df, rule))

    def union_many(self, others: list[KmerIndex], rule: str = "sum") -> KmerIndex:
        return self._with(algebra.union_many([self.df, *[self._checked(o).df for o in others]], rule))

    def intersect_many(self, others: list[KmerIndex], rule: str = "min") -> KmerIndex:
        return self._with(algebra.intersect_many([self.df, *[self._checked(o).df for o in others]], rule))

    def subtract_many(self, others: list[KmerIndex], rule: str = "counters_subtract") -> KmerIndex:
        return self._with(algebra.subtract_many([self.df, *[self._checked(o).df for o in others]], rule))

    def lookup(self, wanted: KmerIndex | list[str]) -> KmerIndex:
        """This index's counts of the k-mers of other sequences or of another index."""
        if isinstance(wanted, list):
            wanted = KmerIndex.of_reads(self.df.sparkSession.createDataFrame([(s,) for s in wanted], "seq string"), self.params)
        return self._with(algebra.lookup(self.df, self._checked(wanted).df))

    # --- results --------------------------------------------------------------------------

    def counted(self, normalize: bool = False) -> DataFrame:
        """``kmer, count``; with ``normalize``, strands that were counted apart are joined."""
        if not normalize or self.params.normalize:
            return self.df
        if self.params.k % 2 == 0:
            raise ValueError("normalizing needs an odd k")
        total = F.least(F.sum("count"), F.lit(MAX_COUNT)).cast("int")
        return self.df.select(canonical("kmer").alias("kmer"), "count").groupBy("kmer").agg(total.alias("count"))

    def histogram(self) -> DataFrame:
        """``abundance, count``: how many k-mers occur so often, rising."""
        return self.df.where("count <> 0").groupBy(F.col("count").alias("abundance")).agg(F.count("*").alias("count")).orderBy("abundance")

    def stats(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """One row: ``totalAbundance, distinctKmers, uniqueKmers, maxAbundance``."""
        return self.filter_counts(low, high).df.agg(
            F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("totalAbundance"),
            F.count("*").alias("distinctKmers"),
            F.coalesce(F.sum((F.col("count") == 1).cast("long")), F.lit(0)).cast("long").alias("uniqueKmers"),
            F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("maxAbundance"),
        )

    def top(self, n: int) -> DataFrame:
        return self.df.orderBy(F.desc("count"), "kmer").limit(n)

    def bottom(self, n: int) -> DataFrame:
        return self.df.orderBy("count", "kmer").limit(n)

    # --- storage --------------------------------------------------------------------------

    def cache(self) -> KmerIndex:
        self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> KmerIndex:
        self.df.unpersist()
        return self

    def repartition(self, buckets: int) -> KmerIndex:
        return KmerIndex(self.df.repartition(buckets, "kmer"), replace(self.params, buckets=buckets), self.motifs)

    def change_ordering(self, ordering: Ordering) -> KmerIndex:
        """Another minimizer ordering: counts don't depend on it, so only the parameters change."""
        check(self.params.k, ordering.m)
        if ordering.kind == "priority":
            raise ValueError("a function can't be stored: make a table of it")
        return KmerIndex(self.df, replace(self.params, m=ordering.m, ordering=ordering.kind, mask=ordering.mask), ordering.table)

    def write(self, location: str) -> None:
        """Bucketed and sorted Parquet with the parameters beside it; equal buckets join without a shuffle."""
        spark = self.df.sparkSession
        table = f"kmers_{uuid.uuid4().hex}"
        (self.df.repartition(self.params.buckets, "kmer").write.mode("overwrite").format("parquet").bucketBy(self.params.buckets, "kmer").sortBy("kmer").option("path", location).saveAsTable(table))
        spark.sql(f"DROP TABLE {table}")  # external: the files stay
        line = json.dumps(asdict(self.params))
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{location}_params")
        if self.motifs is not None:
            self.motifs.select("motif", "rank").write.mode("overwrite").parquet(f"{location}_motifs")

    @classmethod
    def read(cls, spark: SparkSession, location: str) -> KmerIndex:
        found = json.loads(spark.read.text(f"{location}_params").first()[0])
        if found["version"] == 2:
            raise ValueError(f"the index at {location} holds super-mers: SupermerIndex reads it")
        params = Params(**found)
        table = f"kmers_{uuid.uuid4().hex}"
        path = location.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} (kmer STRING, count INT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {params.buckets} BUCKETS LOCATION '{path}'")
        df = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the plan holds what it needs
        return cls(df, params, spark.read.parquet(f"{location}_motifs") if params.ordering == "table" else None)


class Kmers:
    """Files or reads and how they are to be counted: k-mers, super-mers and an index of the same input."""

    def __init__(self, reads: DataFrame, params: Params, ordering: Ordering | None = None, seq: str = "seq", key: str = "read_id"):
        self.reads, self.params, self.seq, self.key = reads, params, seq, key
        self.ordering = ordering or Ordering(params.m, params.ordering, params.mask)

    @classmethod
    def of_files(cls, spark: SparkSession, paths: list[str], params: Params, ordering: Ordering | None = None, long: bool = False) -> Kmers:
        raw = read_sequences(spark, paths, params.k, long).select(F.monotonically_increasing_id().alias("read"), "location", F.col("nucleotides").alias("seq"))
        return cls(fragments(raw, "seq", "location").select(F.struct("read", "location").alias("read_id"), "seq"), params, ordering)

    def index(self, pregroup: bool = False) -> KmerIndex:
        counted = KmerIndex.of_reads(self.reads, self.params, self.seq, pregroup)
        return counted.change_ordering(self.ordering) if self.ordering.kind != "priority" else counted

    def counts(self) -> DataFrame:
        return self.index().df

    def supermers(self) -> DataFrame:
        return supermers(self.reads, self.params.k, self.ordering, self.seq, self.key)

    def bins(self, low: int = 1, high: int | None = None) -> DataFrame:
        return bucket_stats(self.reads, self.params.k, self.ordering, low, high, self.seq, self.key)
