"""Sequence files as DataFrames: FASTA, FASTQ, and long FASTA with or without an index.

Short FASTA records are read by Spark's text reader, so splits, compression and remote stores work as
for any text file. FASTQ and long sequences are read by byte ranges (``ranges``); FASTQ that is
compressed, or in a store that pyarrow doesn't open, is read as numbered lines instead, with the same rows.

Defined results: a record without bases has empty nucleotides; blank lines and line ends of either kind don't
count; a folder is all files in it that Spark would read; the same title in two files, or twice in one, is two
records; no files, or empty ones, give no rows; a FASTQ record that isn't four lines, and an index that doesn't fit
its file, are errors.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import ranges

#: Bytes (or bases of an indexed file) of a task.
SPLIT = 32 << 20
#: Ranges up to which the rows that tell where each begins are broadcast: one row each, counted.
FEW_RANGES = 200_000
SCHEMA = "header string, location bigint, nucleotides string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``uri, bytes`` of a file, of the files of a folder, or of those that match a pattern; names with _ or . in front don't count."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in system.globStatus(p) or []:
        below = system.listStatus(top.getPath()) if top.isDirectory() else [top]
        out += [(f.getPath().toUri().toString(), f.getLen()) for f in below if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not out and not _exists(spark, path):
        raise FileNotFoundError(path)
    return sorted(out)


def _in_ranges(files: list) -> bool:
    """Whether all files can be read from any byte on."""
    if any(f[0].endswith((".gz", ".bz2", ".zst", ".lz4")) for f in files):
        return False
    try:
        for f in files[:1]:
            ranges.open_fs(f[0])
    except Exception:  # a store that only Spark knows
        return False
    return True


def _load(spark: SparkSession, mode: str, files: list, split: int, k: int = 31) -> DataFrame:
    spark.dataSource.register(ranges.SequenceRanges)
    return spark.read.format(ranges.NAME).option("mode", mode).option("files", json.dumps(files)).option("split", str(split)).option("k", str(k)).load()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``title, header, location, nucleotides``: one row per record; header is the title up to its first blank."""
    records = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", r"^>", ""), r"\r", "")
    lines = records.select(F.split(record, "\n", 2).alias("p")).where(F.length(F.trim(F.element_at("p", 1))) > 0)
    body = F.when(F.size("p") > 1, F.regexp_replace(F.element_at("p", 2), r"\s", "")).otherwise("")
    title = F.trim(F.element_at("p", 1))
    return lines.select(title.alias("title"), F.split_part(title, F.lit(" "), F.lit(1)).alias("header"), F.lit(1).cast("long").alias("location"), body.alias("nucleotides"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: every line with its number (from 0) in its file.

    A first pass counts the lines of each split; the running totals (one row per split) give a
    split's first number, and within a split the reader's order does the rest.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    per = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("file").alias("f"), F.col("block").alias("b"), (before - F.col("first")).alias("shift"))
    # a row for each split of 128 MB
    if sum(1 + size // (128 << 20) for _, size in files_of(spark, path)) <= FEW_RANGES:
        offsets = F.broadcast(offsets)
    joined = raw.join(offsets, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return joined.select("file", (F.col("id") + F.col("shift")).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def read_fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """As ``read_fasta``, for records of four lines; qualities are dropped (they may start with @)."""
    files = files_of(spark, path)
    return _load(spark, "fastq", files, split) if _in_ranges(files) else _fastq_by_lines(spark, path)


def _fastq_by_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4).where("part < 2")
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    records = lines.groupBy("file", "record").agg(pick(0).alias("t"), pick(1).alias("nucleotides")).where(F.col("t").startswith("@"))
    title = F.trim(F.substring(F.col("t"), F.lit(2), F.length("t")))
    return records.select(title.alias("title"), F.split_part(title, F.lit(" "), F.lit(1)).alias("header"), F.lit(1).cast("long").alias("location"), F.coalesce(F.trim("nucleotides"), F.lit("")).alias("nucleotides"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, length long, start long, bpsPerLine int, bytesPerLine int").option("sep", "\t").csv(path)


def read_long_fasta(spark: SparkSession, path: str, k: int, split: int = SPLIT, fai: str | None = None) -> DataFrame:
    """Indexed sequences in overlapping pieces: ``title, header, location, nucleotides``.

    A task for every ``split`` bases of the index, which reads k - 1 bases more: every k-mer lies in
    exactly one piece. ``fai`` (else the path with .fai) is a file or a folder with parts of one; for a folder of sequence files
    it is a folder with one such for each, ``name={file}``.
    """
    files = files_of(spark, path)
    index = fai or f"{path}.fai"
    if len(files) == 1 and not _exists(spark, f"{index}/name={files[0][0].rsplit('/', 1)[1]}"):
        named = [(uri, n, index) for uri, n in files]
    else:
        named = [(uri, n, f"{index}/name={uri.rsplit('/', 1)[1]}") for uri, n in files]
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    base = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(whole).toUri().toString()
    return _load(spark, "fai", [(uri, n, base + x.removeprefix(index)) for uri, n, x in named], split, k)


def _placed(segments: DataFrame) -> DataFrame:
    """Segments with the number of their record in its file (``record``), its title (``of``) and how many of its bases come before (``before``)."""
    by = Window.partitionBy("file").orderBy("range", "ordinal")
    numbered = segments.withColumn("record", F.sum(F.col("title").isNotNull().cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("file", "record").orderBy("range", "ordinal")
    before = F.coalesce(F.sum("bases").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("of", F.first("title").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", before)


def read_fasta_pieces(spark: SparkSession, path: str, k: int, split: int = SPLIT) -> DataFrame:
    """Sequences of any length, without an index, in overlapping pieces: as ``read_long_fasta``, with whole titles.

    A first pass gives a row for each title and range; of those that continue a record, each range learns
    its title and place. Bases aren't shuffled unless there are more than ``FEW_RANGES`` ranges.
    """
    files = files_of(spark, path)
    pieces = _load(spark, "pieces", files, split, k)
    carried = _placed(_load(spark, "segments", files, split)).where("title is null").select(F.col("file").alias("f"), F.col("range").alias("r"), "of", "before")
    if sum(-(-n // split) for _, n in files) <= FEW_RANGES:
        carried = F.broadcast(carried)
    goes_on = F.col("title").isNull()
    both = pieces.join(carried, goes_on & (F.col("file") == F.col("f")) & (F.col("range") == F.col("r")), "left")
    title = F.coalesce("title", "of")
    rows = both.select(title.alias("title"), F.split_part(title, F.lit(" "), F.lit(1)).alias("header"), (F.col("at") + 1 + F.when(goes_on, F.coalesce("before", F.lit(0))).otherwise(0)).cast("long").alias("location"), "nucleotides")
    return rows.where("title is not null")


def build_fai(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The index of FASTA files: ``name`` (of the file), ``id, length, start, bpsPerLine, bytesPerLine``, a row for each record, in file order by start."""
    records = _placed(_load(spark, "segments", files_of(spark, path), split)).where("record > 0")
    first = lambda c: F.min(F.when(F.col("title").isNotNull(), F.col(c)))
    found = records.groupBy("file", "record").agg(F.max("of").alias("title"), F.sum("bases").alias("length"), first("start").alias("start"), first("line_bases").alias("bps"), first("line_bytes").alias("bytes"))
    name = F.element_at(F.split("file", "/"), -1)
    return found.select(name.alias("name"), F.split_part("title", F.lit(" "), F.lit(1)).alias("id"), "length", "start", F.col("bps").cast("int").alias("bpsPerLine"), F.col("bytes").cast("int").alias("bytesPerLine"))


def write_fai(spark: SparkSession, path: str, split: int = SPLIT) -> None:
    """Writes the index of each file of ``path`` where ``read_long_fasta`` looks for it."""
    build_fai(spark, path, split).repartition("name").sortWithinPartitions("name", "start").write.mode("overwrite").partitionBy("name").option("sep", "\t").csv(f"{path}.fai")


def read_sequences(spark: SparkSession, paths: list[str], k: int = 31, long: bool = False) -> DataFrame:
    """Files of mixed formats by their names; ``@list`` is a file of paths; no files give no rows.

    long: FASTA records may be too long for one row, so they come in pieces that overlap by k - 1 bases.
    """
    files: list[str] = []
    for p in paths:
        files += [r[0].strip() for r in spark.read.text(p[1:]).collect() if r[0].strip()] if p.startswith("@") else [p]
    parts = []
    for f in files:
        name = f.lower()
        name = name.removesuffix(".gz").removesuffix(".bz2")
        if name.endswith((".fq", ".fastq", "fq", "fastq")):
            parts.append(read_fastq(spark, f))
        elif _exists(spark, f"{f}.fai"):
            parts.append(read_long_fasta(spark, f, k))
        elif long and _in_ranges(files_of(spark, f)):
            parts.append(read_fasta_pieces(spark, f, k))
        else:
            parts.append(read_fasta(spark, f))
    if not parts:
        return spark.createDataFrame([], f"title string, {SCHEMA}")
    return reduce(DataFrame.unionByName, parts)


def sequence_titles(spark: SparkSession, paths: list[str], k: int = 31) -> DataFrame:
    """Titles, distinct within each file, with a number of their own."""
    per_file = [read_sequences(spark, [p], k).select("title").distinct() for p in paths]
    every = reduce(DataFrame.unionAll, per_file) if per_file else spark.createDataFrame([], "title string")
    return every


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """``motif, line``: the first CSV column, numbered in the order of lines (and of files, where there are parts)."""
    lines = numbered_lines(spark, path).where(F.length("value") > 0)
    return numbered(lines, [F.col("file"), F.col("line")], "number").select(F.split_part("value", F.lit(","), F.lit(1)).alias("motif"), F.col("number").alias("line"))


def best_motif_file(spark: SparkSession, folder: str, k: int, m: int) -> str:
    """The file ``minimizers_{k'}_{m}.txt`` with the largest k' of at most k and above m."""
    for kk in range(k, m, -1):
        if _exists(spark, path := f"{folder}/minimizers_{kk}_{m}.txt"):
            return path
    raise FileNotFoundError(f"no minimizer set for k={k}, m={m} in {folder}")
