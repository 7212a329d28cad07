"""Writers: FASTA and TSV of counts, histograms, statistics, super-mers, motif frequencies.

What is there is replaced. Tables without rows give files without lines; a report over no bins has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.minimizer import stats_report

def write_fasta_counts(counts: DataFrame, out: str) -> None:
    """``>count`` and k-mer on two lines each, at ``{out}_counts``."""
    counts.select(F.concat(F.lit(">"), F.col("count"), F.lit("\n"), F.col("kmer")).alias("value")).write.mode("overwrite").text(f"{out}_counts")


def write_tsv(counts: DataFrame, out: str, with_kmers: bool = True) -> None:
    counts.select(*(["kmer"] if with_kmers else []), "count").write.mode("overwrite").option("sep", "\t").csv(f"{out}_counts")


def write_histogram(histogram: DataFrame, out: str) -> None:
    histogram.write.mode("overwrite").option("sep", "\t").csv(f"{out}_counts")


def write_bucket_stats(stats: DataFrame, out: str) -> str:
    """A row for each bin at ``{out}_bucketStats``, and the report over them, which is returned, at ``{out}_stats.txt``."""
    stats.write.mode("overwrite").option("sep", "\t").csv(f"{out}_bucketStats")
    written = stats.sparkSession.read.schema(stats.schema).option("sep", "\t").csv(f"{out}_bucketStats")
    return write_report(stats_report(written).collect(), out, stats.sparkSession)


def write_supermers(supermers: DataFrame, out: str) -> None:
    supermers.select("minimizer", "supermer").write.mode("overwrite").option("sep", "\t").csv(f"{out}_superkmers")


def write_frequencies(table: DataFrame, out: str) -> None:
    """``motif,count`` in order of rank, in as many parts as a sort makes, which are in order too."""
    table.select("rank", "motif", "count").orderBy("rank").select("motif", "count").write.mode("overwrite").csv(f"{out}_minimizers_sample.txt")


def report(rows) -> str:
    """The rows of ``minimizer.stats_report`` as text: a block for each statistic."""
    show = lambda v: "none" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    blocks = []
    for r in sorted(rows, key=lambda r: r["statistic"]):
        blocks.append(f"[{r['statistic']}]\n" + "\n".join(f"{c} = {show(r[c])}" for c in ("bins", "total", "mean", "least", "most", "spread")))
    return "\n".join(blocks)


def write_report(rows, out: str, spark) -> str:
    text = report(rows)
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{out}_stats.txt")
    return text
