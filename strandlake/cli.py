"""Command line: ``python -m strandlake.cli -k 31 reads.fasta count -o out`` and its seven sisters."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import minimizer
from .operators.hitting import bundled
from .operators.index import KmerIndex, Kmers, Params
from .operators.minimizer import Ordering
from .operators.superindex import SupermerIndex, count_by_supermers
from .sources import sequences, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    p.add_argument("-k", type=int, default=None, help="length of k-mers (taken from the index, if one is given)")
    p.add_argument("-m", type=int, default=10, help="length of minimizers")
    p.add_argument("--normalize", action="store_true", help="count a k-mer and its reverse complement as one (odd k)")
    p.add_argument("--ordering", default="frequency", choices=["frequency", "lexicographic", "signature", "random", "given"])
    p.add_argument("--sample", type=float, default=0.01, help="share of the reads that the frequency ordering is sampled from")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--allMinimizers", action="store_true", help="all motifs, not a given set")
    p.add_argument("--minimizers", help="file of motifs, folder of minimizers_{k}_{m}.txt, or bundled: a set that every k-mer holds a motif of")
    p.add_argument("--maxlen", type=int, default=1_000_000, help="accepted and not needed: records of any length are read")
    p.add_argument("--method", choices=["auto", "simple", "pregrouped", "supermers"], default="auto", help="supermers: k-mers go through the shuffle as super-mers")
    p.add_argument("--long", action="store_true", help="FASTA without an index may hold records too long for one row")
    p.add_argument("-p", "--partitions", type=int, default=200)
    sub = p.add_subparsers(dest="command", required=True)

    def verb(name: str, about: str) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=about)
        v.add_argument("files", nargs="*", help="sequence files, or @list")
        v.add_argument("-i", "--index", action="append", default=[], help="stored index")
        v.add_argument("--min", type=int, default=None)
        v.add_argument("--max", type=int, default=None)
        return v

    v = verb("count", "write counted k-mers")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--tsv", action="store_true")
    v.add_argument("--no-sequence", dest="kmers", action="store_false")
    v.add_argument("--buckets", action="store_true", help="write bin statistics")
    v.add_argument("--histogram", action="store_true")
    v.add_argument("--superkmers", action="store_true", help="write super-mers")
    v = verb("stats", "show statistics")
    v.add_argument("-o", "--output")
    v = verb("store", "store an index")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--supermers", action="store_true", help="as super-mers with counts by place; the other verbs take such indexes too, and write them")
    for name, rule, rules in (("intersect", "min", ("sum", "max", "min", "left", "right")), ("union", "sum", ("sum", "max", "min", "left", "right")), ("subtract", "counters_subtract", ("counters_subtract", "kmers_subtract"))):
        v = verb(name, f"{name} indexes")
        v.add_argument("-r", "--rule", default=rule, choices=rules)
        v.add_argument("-o", "--output", required=True)
    verb("sample", "sample and write a minimizer ordering").add_argument("-o", "--output", required=True)
    v = verb("reindex", "store an index under another ordering or number of buckets")
    v.add_argument("-o", "--output", required=True)
    v.add_argument("--changeMinimizers", action="store_true", help="take the ordering asked for; else the index keeps its own")
    v.add_argument("--compatible", help="stored index whose ordering is taken")
    return p


def motifs(spark: SparkSession, a) -> DataFrame:
    """The motif set, with its order: a file's, or all motifs in lexicographic order."""
    if a.minimizers == "bundled" and not a.allMinimizers:
        return bundled(spark, a.k, a.m)
    if a.minimizers and not a.allMinimizers:
        path = a.minimizers if a.minimizers.endswith(".txt") else sequences.best_motif_file(spark, a.minimizers, a.k, a.m)
        return minimizer.given(sequences.read_motifs(spark, path))
    return minimizer.all_motifs(spark, a.m)


def ordering(spark: SparkSession, a, reads: DataFrame | None) -> Ordering:
    some = motifs(spark, a) if a.minimizers and not a.allMinimizers else None
    kind = a.ordering
    if kind == "frequency" and reads is None:
        kind = "given" if some is not None else "lexicographic"
    if kind == "given" and some is None:
        some = motifs(spark, a)
    made = minimizer.make_ordering(spark, kind, a.m, some, reads, a.sample, a.seed)
    if made.table is not None:
        made.table.cache()
    return made


def reads_of(spark: SparkSession, a) -> DataFrame:
    return Kmers.of_files(spark, a.files, Params(a.k, a.m), long=a.long).reads


def pregroup(spark: SparkSession, a, reads: DataFrame) -> bool:
    """auto: pays where a sampled motif is expected to hold very many k-mers."""
    if a.method == "auto":
        return minimizer.pays_to_pregroup(minimizer.frequency_table(reads, minimizer.all_motifs(spark, min(a.m, 10)), min(a.m, 10), a.sample, a.seed))
    return a.method == "pregrouped"


def inputs(spark: SparkSession, a) -> list[KmerIndex]:
    """Stored indexes, then the given files as one more, counted as the first index is."""
    stored = [KmerIndex.read(spark, x) for x in a.index]
    if stored:
        a.k = stored[0].params.k
        a.normalize = stored[0].params.normalize
    if a.k is None:
        raise SystemExit("-k is needed")
    if a.files:
        reads = reads_of(spark, a)
        if stored:
            stored.append(stored[0].of_more_reads(reads, pregroup=pregroup(spark, a, reads)))
        else:
            by = ordering(spark, a, reads if a.command == "store" else None)
            params = Params(a.k, a.m, a.normalize, buckets=a.partitions)
            if a.method == "supermers":
                counted = KmerIndex(count_by_supermers(reads, a.k, by, normalize=a.normalize), params)
            else:
                counted = KmerIndex.of_reads(reads, params, pregroup=pregroup(spark, a, reads))
            stored.append(counted.change_ordering(by))
    if not stored:
        raise SystemExit("no input")
    return stored


def run_supermers(spark: SparkSession, a) -> str | None:
    """The verb over indexes of super-mers; None if there is none among the inputs and none is asked for."""
    kinds = {SupermerIndex.is_at(spark, x) for x in a.index}
    asked = a.command == "store" and a.supermers and not a.index
    if not asked and True not in kinds:
        return None
    if False in kinds:
        raise SystemExit("indexes must all be of one form: store the flat ones anew with --supermers")
    stored = [SupermerIndex.read(spark, x) for x in a.index]
    if stored:
        a.k = stored[0].params.k
    if a.k is None:
        raise SystemExit("-k is needed")
    if a.files:
        reads = reads_of(spark, a)
        if stored:
            stored.append(stored[0].of_more_reads(reads))
        else:
            stored.append(SupermerIndex.of_reads(reads, a.k, ordering(spark, a, reads), normalize=a.normalize, buckets=a.partitions))
    op, rule = {"intersect": "intersect", "subtract": "subtract"}.get(a.command, "union"), getattr(a, "rule", "sum")
    index = stored[0]
    for other in stored[1:]:
        index = getattr(index, op)(other, rule)
    if a.min is not None or a.max is not None:
        index = index.filter_counts(a.min, a.max)
    if a.command == "stats":
        rows = minimizer.stats_report(index.bins()).collect()
        return show(index) + "\n" + (sinks.write_report(rows, a.output, spark) if a.output else sinks.report(rows))
    if a.command == "count":
        if a.buckets or a.superkmers:
            if a.buckets:
                sinks.write_bucket_stats(index.bins(), a.output)
            else:
                sinks.write_supermers(index.supermers(), a.output)
            return f"{a.output}_{'bucketStats' if a.buckets else 'superkmers'}"
        flat = KmerIndex(index.counted(), Params(a.k, min(a.m, a.k - 1), index.params.normalize))
        if a.histogram:
            sinks.write_histogram(flat.histogram(), a.output)
        elif a.tsv:
            sinks.write_tsv(flat.counted(a.normalize), a.output, a.kmers)
        else:
            sinks.write_fasta_counts(flat.counted(a.normalize), a.output)
        return f"{a.output}_counts"
    if a.command == "reindex":
        if a.compatible:
            like = SupermerIndex.read(spark, a.compatible)
            index = index.change_ordering(like.ordering, list(like.params.hot), like.params.digits)
        elif a.changeMinimizers:
            index = index.change_ordering(ordering(spark, a, index.supermers().select(F.col("supermer").alias("seq"))))
        index = index.repartition(a.partitions)
    index.write(a.output)
    return show(SupermerIndex.read(spark, a.output))


def show(index: KmerIndex | SupermerIndex) -> str:
    row = index.stats().first()
    return "\n".join(f"{k}\t{row[k]:,}" for k in ("distinctKmers", "uniqueKmers", "totalAbundance", "maxAbundance"))


def run(spark: SparkSession, argv: list[str]) -> str:
    a = parser().parse_args(argv)
    if a.command == "sample":
        if a.k is None:
            raise SystemExit("-k is needed")
        table = minimizer.frequency_table(reads_of(spark, a), motifs(spark, a), a.m, a.sample, a.seed)
        sinks.write_frequencies(table, a.output)
        return f"{a.output}_minimizers_sample.txt"
    if (done := run_supermers(spark, a)) is not None:
        return done
    found = inputs(spark, a)
    bounded = lambda x: x.filter_counts(a.min, a.max)
    # sums are bounded, not what goes into them
    first, rest = found[0], found[1:]
    if a.command == "count":
        if a.superkmers or a.buckets:
            reads = reads_of(spark, a)
            by = ordering(spark, a, reads)
            if a.superkmers:
                sinks.write_supermers(minimizer.supermers(reads, a.k, by), a.output)
                return f"{a.output}_superkmers"
            sinks.write_bucket_stats(minimizer.bucket_stats(reads, a.k, by, a.min or 1, a.max), a.output)
            return f"{a.output}_bucketStats"
        index = bounded(first.union_many(rest))
        if a.histogram:
            sinks.write_histogram(index.histogram(), a.output)
        elif a.tsv:
            sinks.write_tsv(index.counted(a.normalize), a.output, a.kmers)
        else:
            sinks.write_fasta_counts(index.counted(a.normalize), a.output)
        return f"{a.output}_counts"
    if a.command == "stats":
        index = bounded(first.union_many(rest))
        text = show(index)
        if a.index and not a.files:
            rows = minimizer.stats_report(index.bins().withColumn("superKmers", F.lit(None).cast("long"))).collect()
            text += "\n" + (sinks.write_report(rows, a.output, spark) if a.output else sinks.report(rows))
        if a.files and not a.index:
            reads = reads_of(spark, a)
            stats = minimizer.bucket_stats(reads, a.k, ordering(spark, a, reads), a.min or 1, a.max)
            rows = minimizer.stats_report(stats).collect()
            text += "\n" + (sinks.write_report(rows, a.output, spark) if a.output else sinks.report(rows))
        return text
    if a.command == "store":
        bounded(first.union_many(rest)).repartition(a.partitions).write(a.output)
    elif a.command == "reindex":
        index = bounded(first.union_many(rest))
        if a.compatible:
            index = index.change_ordering(KmerIndex.read(spark, a.compatible).ordering)
        elif a.changeMinimizers:
            # what frequencies are sampled from: the k-mers that the index holds
            index = index.change_ordering(ordering(spark, a, index.df.select(F.col("kmer").alias("seq"))))
        index.repartition(a.partitions).write(a.output)
    else:
        many = {"intersect": first.intersect_many, "union": first.union_many, "subtract": first.subtract_many}[a.command]
        bounded(many(rest, a.rule)).repartition(first.params.buckets).write(a.output)
    return show(KmerIndex.read(spark, a.output))


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    print(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
