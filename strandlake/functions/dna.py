"""Nucleotide column functions: all built from JVM string functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts saturate here.
MAX_COUNT = 2**31 - 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(seq) -> Column:
    """Upper case, U as T, line ends removed; other characters stay (and break fragments)."""
    return F.translate(F.upper(_col(seq)), "U\r\n", "T")


def complement(seq) -> Column:
    return F.translate(_col(seq), "ACGT", "TGCA")


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(_col(kmer), reverse_complement(kmer))


def is_forward(kmer) -> Column:
    """Forward orientation: with odd k, the k-mer is less than its reverse complement.

    With even k the outermost differing pair decides, and a palindrome is not forward.
    """
    return _col(kmer) < reverse_complement(kmer)


def encode(mmer) -> Column:
    """Two bits a base, A=0 C=1 G=2 T=3, as a long (at most 31 bases); its order is that of the strings."""
    return F.conv(F.translate(_col(mmer), "ACGT", "0123"), 4, 10).cast("long")


def decode(code, size: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), size, "0"), "0123", "ACGT")


def capped(count) -> Column:
    c = _col(count)
    # least() would take a null for the cap
    return F.when(c > MAX_COUNT, F.lit(MAX_COUNT)).otherwise(c).cast("int")
