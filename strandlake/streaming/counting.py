"""Incremental k-mer counts over a stream of reads (an extension: the counts only add up).

``stream_counts`` keeps the sums as state. ``count_into`` keeps none: every batch of reads is counted
by itself and written under its number, so that a batch that is repeated after a failure takes the place of its
first try; ``counts_at`` sums the batches up, and ``compact`` makes one of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dna import canonical, capped
from ..operators.sequence import count_kmers, fragments, kmers


def stream_counts(reads: DataFrame, k: int, seq: str = "seq", normalize: bool = False) -> DataFrame:
    """``kmer, count`` for a streaming ``reads``; write it in update or complete mode. Sums need no watermark."""
    if normalize and k % 2 == 0:
        raise ValueError("normalizing needs an odd k")
    each = kmers(fragments(reads.select(seq), seq), k, seq)
    if normalize:
        each = each.withColumn("kmer", canonical("kmer"))
    return each.groupBy("kmer").agg(F.count("*").alias("count"))


def count_into(reads: DataFrame, k: int, location: str, checkpoint: str, seq: str = "seq", normalize: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes the counts of each batch of a streaming ``reads`` to ``{location}/batch={number}``."""

    def write(batch: DataFrame, number: int) -> None:
        count_kmers(batch, k, seq=seq, normalize=normalize).write.mode("overwrite").parquet(f"{location}/batch={number}")

    writer = reads.select(seq).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counts_at(spark: SparkSession, location: str) -> DataFrame:
    """``kmer, count`` of all batches written so far."""
    batches = spark.read.schema("kmer string, count int, batch long").parquet(location)
    return batches.groupBy("kmer").agg(capped(F.sum("count")).alias("count"))


def compact(spark: SparkSession, location: str, out: str) -> None:
    """Writes the sums of the batches as one, that of the last number, to a new location."""
    last = spark.read.schema("kmer string, count int, batch long").parquet(location).agg(F.max("batch")).first()[0]
    if last is not None:
        counts_at(spark, location).write.mode("overwrite").parquet(f"{re.sub('/+$', '', out)}/batch={last}")
