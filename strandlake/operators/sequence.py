"""From sequences to counted k-mers.

Input is any DataFrame with a string column; each step is a projection, a generator or one
hash aggregate, so a count is one shuffle of partially summed k-mers.

Defined results: null sequences, and those shorter than k, give nothing; equal rows each count; counts
saturate at 2**31 - 1; sequences of any length are worked on whole (readers cut long ones into pieces that
overlap by k - 1). Other columns of the reads do no harm: ``fragments`` and ``with_reverse_complements``
carry them along, ``kmers`` and the counts read the named ones only; ``kmers`` rejects kept columns that
are called as its own are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import canonical, capped, is_forward, normalise, reverse_complement

#: Pre-grouping pays if a minimizer is expected to hold this many k-mers.
LARGE_BUCKET = 5_000_000
#: Reads of a task.
ROWS = 1 << 16


def dealt(rows: DataFrame, key: str, counted: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """``rows`` in as many tasks as hold about ``most`` rows each, equal keys together; few rows stay where they are.

    For reads that are made of short keys: a file of keys is a few tasks, however many bases are
    made of them. ``counted`` has as many rows, where those of a stream can't be counted.
    """
    n = -(-(rows if counted is None else counted).count() // most)
    return rows.repartition(n, key) if n > 1 else rows


def fragments(reads: DataFrame, seq: str = "seq", location: str | None = None) -> DataFrame:
    """Maximal runs of valid bases, one row each; other columns stay.

    With ``location`` (the 1-based place of the sequence) each run's own place is returned in
    that column; line ends count in it, as they do in the file.
    """
    others = [c for c in reads.columns if c not in (seq, location)]
    if location is None:
        runs = F.explode(F.regexp_extract_all(normalise(seq), F.lit("([ACGT]+)"), F.lit(1)))
        return reads.select(*others, runs.alias(seq))
    raw = F.translate(F.upper(F.col(seq)), "U", "T")
    valid = r"[ACGT\r\n]+"
    found, gaps = F.regexp_extract_all(raw, F.lit(f"({valid})"), F.lit(1)), F.split(raw, valid, -1)
    placed = F.transform(
        F.sequence(F.lit(1), F.size(found)),
        lambda i: F.struct(
            F.element_at(found, i).alias("run"),
            F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)).alias("gap"),
            F.aggregate(F.slice(found, F.lit(1), i - 1), F.lit(0), lambda a, g: a + F.length(g)).alias("before"),
        ),
    )
    each = reads.where(F.size(found) > 0).select(*others, F.col(location).alias("__at"), F.explode(placed).alias("__f"))
    return each.select(*others, (F.col("__at") + F.col("__f.gap") + F.col("__f.before")).alias(location), F.translate("__f.run", "\r\n", "").alias(seq)).where(F.length(seq) > 0)


def with_reverse_complements(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Each row, and again with its reverse complement."""
    others = [c for c in reads.columns if c != seq]
    return reads.select(*others, F.explode(F.array(F.col(seq), reverse_complement(seq))).alias(seq))


def kmers(reads: DataFrame, k: int, seq: str = "seq", *keep: str) -> DataFrame:
    """Every window of ``k`` bases, with ``keep`` columns; sequences shorter than k give none."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if clash := {"at", "kmer"} & set(keep):
        raise ValueError(f"columns that k-mers bring themselves can't be kept: {sorted(clash)}")
    at = F.explode(F.sequence(F.lit(1), F.length(seq) - (k - 1))).alias("at")
    # places in a string are counted from its start, those of bytes are not
    single = F.when(F.octet_length(seq) == F.length(seq), F.col(seq).cast("binary"))
    each = reads.where(F.length(seq) >= k).select(*keep, seq, single.alias("__bytes")).select(*keep, seq, "__bytes", at)
    cut = F.when(F.col("__bytes").isNotNull(), F.substring("__bytes", F.col("at"), F.lit(k)).cast("string")).otherwise(F.substring(F.col(seq), F.col("at"), F.lit(k)))
    return each.select(*keep, "at", cut.alias("kmer"))


def count_kmers(reads: DataFrame, k: int, *, seq: str = "seq", normalize: bool = False, forward_only: bool = False, pregroup: bool = False, clean: bool = True) -> DataFrame:
    """``kmer, count`` (int, saturating).

    normalize: a k-mer and its reverse complement are one (odd k only). forward_only: keeps
    k-mers in forward orientation without adding complements. pregroup: equal sequences are
    counted before they are cut, which pays if they repeat. clean: cut at invalid bases first.
    """
    if normalize and k % 2 == 0:
        raise ValueError("normalizing needs an odd k")
    one = reads.select(seq)
    if clean:
        one = fragments(one, seq)
    if pregroup:
        one = one.groupBy(seq).agg(F.count("*").alias("w"))
        each, total = kmers(one, k, seq, "w"), F.sum("w")
    else:
        each, total = kmers(one, k, seq), F.count("*")
    if normalize:
        each = each.withColumn("kmer", canonical("kmer"))
    if forward_only:
        each = each.where(is_forward("kmer"))
    return each.groupBy("kmer").agg(capped(total).alias("count"))


def titles(reads: DataFrame, title: str = "header") -> DataFrame:
    return reads.select(F.col(title).alias("title")).distinct()
