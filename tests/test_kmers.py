import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions import dna
from strandlake.operators import algebra, minimizer
from strandlake.operators.index import KmerIndex, Kmers, Params
from strandlake.operators.minimizer import Ordering
from strandlake.operators.sequence import count_kmers, fragments, kmers
from strandlake.operators.superindex import SupermerIndex
from strandlake.sources import sequences
from strandlake.streaming.counting import compact, count_into, counts_at, stream_counts

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def counts(df):
    return {r.kmer: r["count"] for r in df.collect()}


def test_toy_counts(spark):
    df = reads(spark, ["CATCATCAG", "GATCATT", "ACG"])
    want = {"CATC": 2, "ATCA": 3, "TCAT": 2, "TCAG": 1, "GATC": 1, "CATT": 1}
    assert counts(count_kmers(df, 4)) == counts(count_kmers(df, 4, pregroup=True)) == want
    assert counts(count_kmers(df, 4, forward_only=True)) == {k: n for k, n in want.items() if k < rc(k)}
    index = KmerIndex.of_reads(df, Params(4, 3))
    assert counts(index.filter_min(2).df) == {"CATC": 2, "ATCA": 3, "TCAT": 2}
    assert len(counts(index.filter_max(1).df)) == 3
    assert index.filter_counts(1, None).df is not None and counts(index.counted()) == want


def test_toy_supermers(spark):
    # least 2-mers: AC of CACC and GACC, then CC, then CG
    df = reads(spark, ["CACCG", "GACCCG", "AAAA", "", None])
    got = minimizer.supermers(df, 4, Ordering(2)).orderBy("read_id", "start").collect()
    assert [(r.read_id, r.minimizer, r.supermer) for r in got] == [(0, "AC", "CACCG"[:5]), (1, "AC", "GACCC"), (1, "CC", "CCCG"), (2, "AA", "AAAA")]
    motifs = minimizer.motif_counts(reads(spark, ["GATTAC", "TTAGNTAGG"]), 3)
    assert counts(motifs.withColumnRenamed("motif", "kmer")) == {"GAT": 1, "ATT": 1, "TTA": 2, "TAC": 1, "TAG": 2, "AGG": 1}


def test_rows_that_are_alike_keep_their_own_supermers(spark):
    df = spark.createDataFrame([(1, "CATCATCAGGATTACA")] * 2 + [(None, "CATCATCAGGATTACA")], "read_id long, seq string")
    table = minimizer.all_motifs(spark, 3)
    for by in (Ordering(3), minimizer.make_ordering(spark, "lexicographic", 3, table), minimizer.make_ordering(spark, "random", 3, table, seed=5)):
        one = sorted(r.supermer for r in minimizer.supermers(df.limit(1), 6, by).collect())
        assert sorted(r.supermer for r in minimizer.supermers(df, 6, by).collect()) == sorted(3 * one)


def test_bounds_hold_for_sums(spark, tmp_path):
    a, b = (write(tmp_path / f"{x}.fasta", ">r\nCATCAT\n") for x in "ab")
    out = str(tmp_path / "both")
    cli.run(spark, ["-k", "4", "-m", "2", "--ordering", "lexicographic", "store", a, "-o", f"{out}_a"])
    cli.run(spark, ["-k", "4", "-m", "2", "count", "-i", f"{out}_a", b, "-o", out, "--tsv", "--min", "2"])
    assert sorted(r[0] for r in spark.read.text(f"{out}_counts").collect()) == ["ATCA\t2", "CATC\t2", "TCAT\t2"]


def test_orderings_are_kept_changed_and_taken_over(spark, tmp_path):
    a = write(tmp_path / "a.fasta", ">r\nCATCATCAGGATTACA\n")
    at = lambda x: str(tmp_path / x)
    run = lambda *x: cli.run(spark, ["-p", "2", "--sample", "1", *x])
    run("-k", "6", "-m", "3", "--ordering", "frequency", "store", a, "-o", at("A"))
    first = KmerIndex.read(spark, at("A"))
    assert first.params.ordering == "table" and first.motifs.count() == 64
    run("reindex", "-i", at("A"), "-o", at("B"))
    assert KmerIndex.read(spark, at("B")).params.ordering == "table"
    run("-m", "3", "--ordering", "signature", "reindex", "-i", at("A"), "-o", at("C"), "--changeMinimizers")
    assert KmerIndex.read(spark, at("C")).params.ordering == "signature"
    run("reindex", "-i", at("A"), "-o", at("D"), "--compatible", at("C"))
    assert KmerIndex.read(spark, at("D")).params.ordering == "signature"
    assert "[totalAbundance]" in run("stats", "-i", at("A"))
    whole = {r.minimizer: r.totalAbundance for r in Kmers.of_files(spark, [a], Params(6, 3), first.ordering).bins().collect()}
    assert {r.minimizer: r.totalAbundance for r in first.bins().collect()} == whole


@SLOW
@given(st.lists(st.text("ACGT", min_size=1, max_size=100), min_size=1, max_size=6), st.sampled_from([3, 5, 31, 55]), st.booleans())
def test_counts_are_those_of_sliding_windows(spark, seqs, k, normalize):
    want = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))
    if normalize:
        joined = Counter()
        for x, n in want.items():
            joined[min(x, rc(x))] += n
        want = joined
    df = reads(spark, seqs)
    assert counts(count_kmers(df, k, normalize=normalize)) == want == counts(count_kmers(df, k, normalize=normalize, pregroup=True))


@SLOW
@given(st.lists(st.text("ACGT", min_size=1, max_size=60), min_size=1, max_size=5), st.integers(2, 4), st.integers(1, 8), st.sampled_from(["lexicographic", "signature", "random"]))
def test_supermers_lose_nothing(spark, seqs, m, more, kind):
    k = m + more
    df = reads(spark, seqs)
    by = Ordering(m, kind, 0b0110 if kind == "random" else 0)
    low = lambda x: (x.find("AA") > 0) or x.startswith(("AAA", "ACA"))
    code = lambda x: sum("ACGT".index(c) * 4 ** (len(x) - 1 - i) for i, c in enumerate(x))
    rank = {"lexicographic": lambda x: x, "signature": lambda x: (low(x), x), "random": lambda x: code(x) ^ 0b0110}[kind]
    got = minimizer.supermers(df, k, by).collect()
    seen = Counter()
    for r in got:
        s = seqs[r.read_id]
        assert s[r.start : r.start + len(r.supermer)] == r.supermer
        assert s[r.minimizer_start : r.minimizer_start + m] == r.minimizer
        for i in range(r.start, r.start + len(r.supermer) - k + 1):
            seen[r.read_id, i] += 1
            best = min(range(i, i + k - m + 1), key=lambda j: (rank(s[j : j + m]), j))
            assert best == r.minimizer_start
    assert seen == Counter((n, i) for n, s in enumerate(seqs) for i in range(len(s) - k + 1))


RULES = {
    "sum": lambda a, b: a + b, "max": max, "min": min, "left": lambda a, b: a, "right": lambda a, b: b, "counters_subtract": lambda a, b: a - b,
}


@SLOW
@given(*[st.dictionaries(st.text("ACGT", min_size=3, max_size=3), st.integers(1, 2**31 - 1), max_size=12)] * 2)
def test_rules_by_truth_table(spark, a, b):
    x, y = (spark.createDataFrame(list(d.items()), "kmer string, count int") for d in (a, b))
    kept = lambda d: {k: min(v, 2**31 - 1) for k, v in d.items() if v > 0}
    for rule, f in RULES.items():
        assert counts(algebra.intersect(x, y, rule)) == kept({k: f(a[k], b[k]) for k in a.keys() & b.keys()})
        if rule != "counters_subtract":
            assert counts(algebra.union(x, y, rule)) == kept({k: f(a[k], b[k]) if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()})
    assert counts(algebra.subtract(x, y)) == kept({k: v - b.get(k, 0) for k, v in a.items()})
    assert counts(algebra.subtract(x, y, "kmers_subtract")) == {k: v for k, v in a.items() if k not in b}
    assert counts(algebra.lookup(x, y)) == {k: v for k, v in a.items() if k in b}


def test_chains_keep_every_kmer_once(spark):
    make = lambda d: KmerIndex(spark.createDataFrame(list(d.items()), "kmer string, count int"), Params(3, 2))
    a, b, c = make({"AAA": 1, "CCC": 5}), make({"AAA": 5}), make({"AAA": 7, "GGG": 1})
    assert counts(a.filter_min(2).union(b).union(c).df) == {"AAA": 12, "CCC": 5, "GGG": 1}
    assert counts(a.change_ordering(Ordering(2, "signature")).union(c).df) == {"AAA": 8, "CCC": 5, "GGG": 1}
    with pytest.raises(ValueError):
        a.union(KmerIndex.empty(spark, Params(5, 2)))
    with pytest.raises(ValueError):
        algebra.intersect(a.df, b.df, "kmers_subtract")
    with pytest.raises(ValueError):
        Params(4, 2, normalize=True)


def test_encoding_and_fragments(spark):
    rnd = random.Random(1)
    mmers = ["".join(rnd.choice("ACGT") for _ in range(9)) for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in mmers], "x string").select("x", dna.encode("x").alias("c")).select("x", "c", dna.decode("c", 9).alias("y"), dna.reverse_complement("x").alias("r"))
    assert all(r.x == r.y and r.r == rc(r.x) for r in df.collect())
    assert [r.x for r in df.orderBy("c").collect()] == sorted(mmers)
    raw = spark.createDataFrame([(1, "acgNNuu\ntgX\n", 10)], "id long, seq string, at long")
    assert [tuple(r) for r in fragments(raw, "seq", "at").orderBy("at").collect()] == [(1, 10, "ACG"), (1, 15, "TTTG")]
    assert [r.seq for r in fragments(raw, "seq").orderBy("seq").collect()] == ["ACG", "TTTG"]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_files_and_commands(spark, tmp_path):
    fasta = write(tmp_path / "a.fasta", ">r1 first\nGATTA\nCAGGC\n>r2\nACAGGATTA\n")
    fastq = write(tmp_path / "b.fastq", "@q1 x\nGATTACAGGC\n+\n@@@@@@@@@@\n@q2\nACAGGATTA\n+q2\nIIIIIIIII\n")
    listed = write(tmp_path / "list.txt", f"{fasta}\n{fastq}\n")
    got = sequences.read_sequences(spark, [f"@{listed}"]).collect()
    assert sorted((r.header, r.nucleotides) for r in got) == [("q1", "GATTACAGGC"), ("q2", "ACAGGATTA"), ("r1", "GATTACAGGC"), ("r2", "ACAGGATTA")]
    assert sorted(r.title for r in sequences.sequence_titles(spark, [fasta, fastq]).collect()) == ["q1 x", "q2", "r1 first", "r2"]
    assert sequences.read_sequences(spark, []).count() == 0
    rnd = random.Random(3)
    chrom = {"c1": "".join(rnd.choice("ACGT") for _ in range(1003)), "c2": "".join(rnd.choice("ACGT") for _ in range(77))}
    text, fai = "", ""
    for name, s in chrom.items():
        text += f">{name} long\n"
        fai += f"{name}\t{len(s)}\t{len(text)}\t10\t11\n"
        text += "".join(s[i : i + 10] + "\n" for i in range(0, len(s), 10))
    long = write(tmp_path / "c.fasta", text)
    write(tmp_path / "c.fasta.fai", fai)
    pieces = sequences.read_long_fasta(spark, long, 23, split=70).collect()
    assert len(pieces) > 10 and all(chrom[p.header][p.location - 1 :].startswith(p.nucleotides) for p in pieces)
    df = spark.createDataFrame([(p.nucleotides,) for p in pieces], "seq string")
    assert counts(count_kmers(df, 23)) == Counter(s[i : i + 23] for s in chrom.values() for i in range(len(s) - 22))
    a, b, c = (str(tmp_path / x) for x in ("A", "B", "C"))
    cli.run(spark, ["-k", "4", "-m", "2", "-p", "3", "store", fasta, "-o", a])
    cli.run(spark, ["-k", "4", "-m", "2", "-p", "3", "store", fastq, "-o", b])
    assert "totalAbundance\t26" in cli.run(spark, ["intersect", "-i", a, "-i", b, "-r", "sum", "-o", c])
    assert counts(KmerIndex.read(spark, c).df) == {k: 2 * v for k, v in counts(KmerIndex.read(spark, a).df).items()}
    out = str(tmp_path / "out")
    cli.run(spark, ["-k", "4", "-m", "2", "count", fasta, "-o", out, "--tsv", "--min", "2"])
    assert sorted(r[0] for r in spark.read.text(f"{out}_counts").collect()) == ["ACAG\t2", "ATTA\t2", "CAGG\t2", "GATT\t2"]
    assert "totalAbundance\t13" in cli.run(spark, ["-k", "4", "-m", "2", "--sample", "1", "stats", fasta])
    for more in (["--superkmers"], ["--buckets"], ["--histogram"]):
        cli.run(spark, ["-k", "4", "-m", "2", "--ordering", "lexicographic", "count", fasta, "-o", str(tmp_path / more[0][2:]), *more])
    cli.run(spark, ["-k", "4", "-m", "2", "--sample", "1", "sample", fasta, "-o", out])
    assert spark.read.text(f"{out}_minimizers_sample.txt").count() == 16
    cli.run(spark, ["-m", "3", "--ordering", "signature", "-p", "2", "reindex", "-i", a, "-o", str(tmp_path / "D"), "--changeMinimizers"])
    assert counts(KmerIndex.read(spark, str(tmp_path / "D")).df) == counts(KmerIndex.read(spark, a).df)


def test_commands_on_supermers(spark, tmp_path):
    rnd = random.Random(4)
    genome = "".join(rnd.choice("ACGT") for _ in range(300))
    one = write(tmp_path / "a.fasta", "".join(f">r{i}\n{genome[i * 20 : i * 20 + 60]}\n" for i in range(12)))
    two = write(tmp_path / "b.fasta", f">all\n{genome[100:]}\n")
    ks = lambda *seqs: Counter(s[i : i + 11] for s in seqs for i in range(len(s) - 10))
    ca, cb = ks(*[genome[i * 20 : i * 20 + 60] for i in range(12)]), ks(genome[100:])
    a, b, c, d, e = (str(tmp_path / x) for x in "ABCDE")
    base = ["-k", "11", "-m", "4", "-p", "3", "--ordering", "signature"]
    cli.run(spark, [*base, "store", one, "-o", a, "--supermers"])
    cli.run(spark, [*base, "--long", "store", two, "-o", b, "--supermers"])
    assert SupermerIndex.is_at(spark, a) and counts(SupermerIndex.read(spark, a).counted()) == ca
    total = sum((ca & cb).values())
    assert f"totalAbundance\t{total:,}" in cli.run(spark, ["intersect", "-i", a, "-i", b, "-o", c])
    assert counts(SupermerIndex.read(spark, c).counted()) == ca & cb
    cli.run(spark, ["union", "-i", a, two, "-o", d, "--min", "2"])
    assert counts(SupermerIndex.read(spark, d).counted()) == {q: n for q, n in (ca + cb).items() if n > 1}
    text = cli.run(spark, ["-m", "3", "stats", "-i", a])
    assert f"totalAbundance\t{sum(ca.values()):,}" in text and "[superKmers]" in text and "none" not in text.split("[superKmers]")[1].split("[")[0]
    cli.run(spark, ["-m", "3", "--ordering", "lexicographic", "-p", "2", "reindex", "-i", a, "-o", e, "--changeMinimizers"])
    again = SupermerIndex.read(spark, e)
    assert (again.params.m, again.params.ordering, again.params.buckets) == (3, "lexicographic", 2) and counts(again.counted()) == ca
    out = str(tmp_path / "out")
    cli.run(spark, ["count", "-i", a, "-o", out, "--tsv"])
    assert dict(r[0].split("\t") for r in spark.read.text(f"{out}_counts").collect()) == {q: str(n) for q, n in ca.items()}
    cli.run(spark, [*base, "--method", "supermers", "count", one, "-o", out, "--tsv"])
    assert dict(r[0].split("\t") for r in spark.read.text(f"{out}_counts").collect()) == {q: str(n) for q, n in ca.items()}
    with pytest.raises(ValueError):
        KmerIndex.read(spark, a)
    flat = str(tmp_path / "F")
    cli.run(spark, [*base, "store", one, "-o", flat])
    with pytest.raises(SystemExit):
        cli.run(spark, ["union", "-i", a, "-i", flat, "-o", c])


def test_stored_indexes_join_without_a_shuffle(spark, tmp_path):
    for name in "ab":
        KmerIndex.of_reads(reads(spark, ["GATTACAGGC"]), Params(4, 2, buckets=4)).write(str(tmp_path / name))
    a, b = (KmerIndex.read(spark, str(tmp_path / name)) for name in "ab")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (a.union(b).df, a.intersect(b).df, a.subtract(b, "kmers_subtract").df):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_filters_reach_the_files(spark, tmp_path):
    KmerIndex.of_reads(reads(spark, ["GATTACAGGC"]), Params(4, 2, buckets=2)).write(str(tmp_path / "x"))
    plan = KmerIndex.read(spark, str(tmp_path / "x")).filter_min(2).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(count,2)" in plan


def test_stream_adds_up(spark, tmp_path):
    src = tmp_path / "in"
    reads(spark, ["GATTACAGGC"]).write.parquet(str(src))
    reads(spark, ["ACAGGATTA"]).write.mode("append").parquet(str(src))
    stream = stream_counts(spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(src)), 4)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("added").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert counts(spark.table("added")) == counts(count_kmers(reads(spark, ["GATTACAGGC", "ACAGGATTA"]), 4))
    assert spark.table("added").where(F.col("kmer") == "ACAG").first()["count"] == 2
    out = str(tmp_path / "counts")
    again = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    count_into(again, 4, out, str(tmp_path / "cp2")).awaitTermination()
    assert counts(counts_at(spark, out)) == counts(spark.table("added"))
    # a batch that is written again takes the place of the first
    count_kmers(reads(spark, ["ACAGGATTA"]), 4).write.mode("overwrite").parquet(f"{out}/batch=7")
    count_kmers(reads(spark, ["ACAGGATTA"]), 4).write.mode("overwrite").parquet(f"{out}/batch=7")
    compact(spark, out, str(tmp_path / "one"))
    assert counts(counts_at(spark, str(tmp_path / "one"))) == counts(count_kmers(reads(spark, ["GATTACAGGC", "ACAGGATTA", "ACAGGATTA"]), 4))


def test_nulls_repeats_and_clashing_names(spark):
    odd = spark.createDataFrame([(1, "ACGTA", "x", 5), (1, "ACGTA", "x", 5), (2, None, "y", 6), (3, "", "z", 7), (None, "AC", None, None)], "read_id long, seq string, kmer string, count int")
    assert counts(count_kmers(odd, 3)) == {"ACG": 2, "CGT": 2, "GTA": 2}
    assert sorted(fragments(odd).select("kmer", "seq").collect(), key=str) == sorted([("x", "ACGTA"), ("x", "ACGTA"), (None, "AC")], key=str)
    with pytest.raises(ValueError):
        kmers(odd, 3, "seq", "kmer")
    frame = lambda rows: spark.createDataFrame(rows, "kmer string, count int, a int, b int, u string")
    a, b = frame([("AC", 3, 9, 9, "q"), ("GG", None, 9, 9, "q"), (None, 2, 9, 9, "q")]), frame([("AC", 2, 8, 8, "r"), ("TT", 4, 8, 8, "r"), (None, 5, 8, 8, "r")])
    assert sorted(map(tuple, algebra.union(a, b).collect()), key=str) == sorted([("AC", 5), ("TT", 4), (None, 2), (None, 5)], key=str)
    assert [tuple(r) for r in algebra.intersect(a, b).collect()] == [("AC", 2)]
    assert sorted(map(tuple, algebra.subtract(a, b).collect()), key=str) == sorted([("AC", 1), (None, 2)], key=str)
    none = spark.createDataFrame([], "kmer string, count int")
    ix = KmerIndex(none, Params(3, 2))
    assert tuple(ix.stats().first()) == (0, 0, 0, 0) and ix.histogram().count() == 0 and ix.union(ix).df.count() == 0
    from strandlake.functions.udtf import register

    register(spark)
    odd.createOrReplaceTempView("odd")
    assert sorted(map(tuple, spark.sql("SELECT read_id, at, k.kmer FROM odd o, LATERAL kmers(o.seq, 4) k").collect())) == [(1, 1, "ACGT"), (1, 1, "ACGT"), (1, 2, "CGTA"), (1, 2, "CGTA")]
    assert sorted(map(tuple, spark.sql("SELECT s.* FROM odd o, LATERAL supermers(o.seq, 3, 2) s").collect())) == [("AC", 0, "ACG"), ("AC", 0, "ACG"), ("CG", 1, "CGT"), ("CG", 1, "CGT"), ("GT", 2, "GTA"), ("GT", 2, "GTA")]


def test_reads_of_a_single_file_of_keys_are_dealt_to_tasks(spark, tmp_path):
    from strandlake.operators.sequence import dealt

    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id % 300 AS key").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    out = dealt(rows, "key", most=100)
    parts = out.selectExpr("key", "spark_partition_id() AS p").collect()
    assert out.rdd.getNumPartitions() == 10 and len({r.p for r in parts}) > 5
    assert len({(r.key, r.p) for r in parts}) == 300 and len(parts) == 1000
    assert dealt(rows, "key").rdd.getNumPartitions() == 1


def test_kmers_of_a_long_sequence_take_time_in_proportion(spark):
    import time

    seq = "".join(random.Random(9).choice("ACGT") for _ in range(800_000))
    reads = spark.createDataFrame([(1, seq)], "id int, seq string")
    start = time.time()
    rows = count_kmers(reads, 31).count()
    assert rows == len({seq[i : i + 31] for i in range(len(seq) - 30)}) and time.time() - start < 60


def test_kmers_of_other_characters(spark):
    texts = ["ACGTNÉACGT日本ACGT", "ACGTACG", "ÉÉ", None]
    reads = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, seq string")
    got = sorted((r.id, r.at, r.kmer) for r in kmers(reads, 3, "seq", "id").collect())
    assert got == sorted((i, a + 1, t[a : a + 3]) for i, t in enumerate(texts) if t for a in range(len(t) - 2))
