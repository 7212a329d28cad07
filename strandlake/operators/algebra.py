"""Multiset algebra of counted k-mers: joins on distinct ``kmer`` rows under a count rule.

Defined results: an operand has one row for each k-mer, as counts and stored indexes do (``unionByName`` of two
counts doesn't: sum it up first); a null k-mer matches nothing, so intersections drop it and unions keep each
side's; a null count is as if the k-mer were absent, and a result whose count is null or not above 0
goes; sums saturate at 2**31 - 1; an empty operand is the empty multiset; only ``kmer`` and ``count`` are read,
whatever other columns are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import capped

RULES = ("sum", "max", "min", "left", "right", "counters_subtract", "kmers_subtract")


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("kmer", F.col("count").alias("a")).join(b.select("kmer", F.col("count").alias("b")), "kmer", how)


def _kept(joined: DataFrame, count: Column) -> DataFrame:
    return joined.select("kmer", capped(count).alias("count")).where("count > 0")


def _both(rule: str) -> Column:
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    try:
        return {"sum": a + b, "max": F.greatest(a, b), "min": F.least(a, b), "left": a, "right": b, "counters_subtract": a - b}[rule]
    except KeyError:
        raise ValueError(f"no such rule here: {rule}") from None


def union(a: DataFrame, b: DataFrame, rule: str = "sum") -> DataFrame:
    """K-mers of either side. A k-mer that one side lacks keeps the other's count."""
    if rule not in ("sum", "max", "min", "left", "right"):
        raise ValueError(f"no such rule for a union: {rule}")
    one = F.coalesce(F.col("a"), F.col("b")).cast("long")
    return _kept(_sides(a, b, "full"), F.when(F.col("a").isNull() | F.col("b").isNull(), one).otherwise(_both(rule)))


def intersect(a: DataFrame, b: DataFrame, rule: str = "min") -> DataFrame:
    """K-mers of both sides."""
    if rule == "kmers_subtract":
        raise ValueError("an intersection can't subtract k-mers")
    return _kept(_sides(a, b, "inner"), _both(rule))


def subtract(a: DataFrame, b: DataFrame, rule: str = "counters_subtract") -> DataFrame:
    """counters_subtract: counts of a less those of b; kmers_subtract: k-mers of a that b lacks."""
    if rule == "kmers_subtract":
        return a.select("kmer", "count").join(b.select("kmer"), "kmer", "left_anti")
    if rule != "counters_subtract":
        raise ValueError(f"no such rule for a subtraction: {rule}")
    return _kept(_sides(a, b, "left"), F.col("a").cast("long") - F.coalesce(F.col("b"), F.lit(0)))


def _many(op, parts: list[DataFrame], rule: str) -> DataFrame:
    if not parts:
        raise ValueError("at least one index is needed")
    return reduce(lambda x, y: op(x, y, rule), parts)


def union_many(parts: list[DataFrame], rule: str = "sum") -> DataFrame:
    """A left fold; sums, maxima and minima of any number of parts are one aggregate instead."""
    if rule in ("sum", "max", "min") and len(parts) > 2:
        every = reduce(DataFrame.unionByName, [p.select("kmer", "count") for p in parts])
        return every.groupBy("kmer").agg(capped({"sum": F.sum, "max": F.max, "min": F.min}[rule]("count")).alias("count"))
    return _many(union, parts, rule)


def intersect_many(parts: list[DataFrame], rule: str = "min") -> DataFrame:
    return _many(intersect, parts, rule)


def subtract_many(parts: list[DataFrame], rule: str = "counters_subtract") -> DataFrame:
    return _many(subtract, parts, rule)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index's counts of the k-mers in ``wanted(kmer)``."""
    return index.select("kmer", "count").join(wanted.select("kmer"), "kmer", "left_semi")
