import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import minimizer, packed, superindex
from strandlake.operators.minimizer import Ordering
from strandlake.operators.numbering import numbered
from strandlake.operators.sequence import count_kmers
from strandlake.operators.superindex import SupermerIndex, count_by_supermers, cut_kmers, hot_minimizers, packed_supermers, routed
from strandlake.plans import queries


def dna(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def brute(seq, k, m, rank):
    """minimizer place, start and super-mer of each run of k-mers with one minimizer occurrence."""
    out, held = [], None
    for i in range(len(seq) - k + 1):
        p = min(range(i, i + k - m + 1), key=lambda j: (rank(seq[j : j + m]), j))
        if p != held:
            out.append([p, i, i])
            held = p
        out[-1][2] = i
    return [(p, a, seq[a : z + k]) for p, a, z in out]


def code_of(s):
    return int(s.translate(str.maketrans("ACGT", "0123")), 4)


def is_low(s):
    return s.find("AA") > 0 or s.startswith(("AAA", "ACA"))


RANKS = {"lexicographic": code_of, "signature": lambda s: (is_low(s), code_of(s)), "random": lambda s: code_of(s) ^ 0x2B}


@pytest.mark.parametrize("kind", RANKS)
def test_cut_against_every_window(kind):
    rnd = random.Random(1)
    for m, k in ((1, 2), (2, 3), (3, 9), (4, 31), (11, 12)):
        seqs = [dna(rnd, n) for n in (k, k + 1, 70, 300, 33)] + ["A" * 90, "AC" * 40, dna(rnd, k - 1), ""]
        code, length = packed.bases_of(pa.array(seqs))
        s = packed.cut(code, length, k, packed.Ranks(m, kind, 0x2B if kind == "random" else 0))
        heads = np.cumsum(length) - length
        got = [[] for _ in seqs]
        for r, p, a, n in zip(s.read, s.motif, s.place, s.n, strict=True):
            got[r].append((p - heads[r], a - heads[r], seqs[r][a - heads[r] : a - heads[r] + n + k - 1]))
        assert got == [brute(x, k, m, RANKS[kind]) for x in seqs]


def test_window_minima():
    rng = np.random.default_rng(2)
    for n, w in ((0, 3), (2, 3), (3, 3), (50, 1), (50, 7), (64, 8), (65, 64)):
        x = rng.integers(0, 5, n)
        assert packed.window_least(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]
        assert packed.window_places(x, w).tolist() == [i + int(x[i : i + w].argmin()) for i in range(n - w + 1)]
    large = np.array([2**61, 5, 2**61 + 1, 5])
    assert packed.window_places(large, 2).tolist() == [1, 1, 3]


def test_words_come_back_as_bases():
    rnd = random.Random(3)
    seqs = [dna(rnd, n) for n in (1, 30, 31, 32, 61, 62, 63, 200)]
    code, length = packed.bases_of(pa.array(seqs))
    words = packed.word_lists(packed.words_of(code, np.cumsum(length) - length, length), length)
    owner = np.repeat(np.arange(len(seqs)), [len(w) for w in words.to_pylist()])
    assert [len(w) for w in words.to_pylist()] == [-(-len(s) // 31) for s in seqs]
    back = packed.bases_of_words(words.flatten().to_numpy(), owner, length)
    assert (back == code).all()
    assert packed.strings(code, np.cumsum(length) - length, length).to_pylist() == seqs
    with pytest.raises(ValueError):
        packed.bases_of(pa.array(["ACN"]))


def test_equal_rows_are_summed():
    rows = np.array([[1, 2], [3, 4], [1, 2], [1, 3]])
    got, weight = packed.combined(rows, np.array([1, 2, 3, 4]))
    assert sorted((*r, w) for r, w in zip(got.tolist(), weight.tolist(), strict=True)) == [(1, 2, 4), (1, 3, 4), (3, 4, 2)]


def test_long_reads_take_time_by_their_length(spark):
    rnd = random.Random(4)
    ordering = Ordering(8, "signature")
    took = []
    for n in (100_000, 400_000):
        seq = dna(rnd, n)
        reads = spark.createDataFrame([(1, seq)], "read_id long, seq string")
        minimizer.supermers(reads, 55, ordering).count()
        start = time.time()
        rows = minimizer.supermers(reads, 55, ordering).collect()
        took.append(time.time() - start)
        if n == 100_000:
            code = packed.bases_of(pa.array([seq]))
            assert len(rows) == len(packed.cut(*code, 55, packed.Ranks(8, "signature")).n)
            assert [(r.minimizer_start, r.start, r.supermer) for r in sorted(rows, key=lambda r: r.start)][:40] == brute(seq[:3000], 55, 8, RANKS["signature"])[:40]
    assert took[1] < 12 * took[0] + 2


def test_windows_of_a_priority_in_columns(spark):
    rnd = random.Random(5)
    seqs = [dna(rnd, n) for n in (9, 12, 40, 77)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    for k, m in ((9, 2), (9, 8), (5, 4)):
        got = minimizer.supermers(reads, k, Ordering(m, "priority", priority=F.reverse)).collect()
        assert sorted((r.read_id, r.minimizer_start, r.start, r.supermer) for r in got) == sorted((i, *x) for i, s in enumerate(seqs) for x in brute(s, k, m, lambda t: t[::-1]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_orderings_shuffle_no_reads(spark):
    rnd = random.Random(6)
    reads = spark.createDataFrame([(i, dna(rnd, 60)) for i in range(40)], "read_id long, seq string")
    table = minimizer.frequency_table(reads, minimizer.all_motifs(spark, 4), 4)
    assert sorted(r["rank"] for r in table.collect()) == list(range(256))
    got = minimizer.supermers(reads, 9, Ordering(4, "table", table=table))
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    rank = {r.motif: r["rank"] for r in table.collect()}
    assert sorted((r.read_id, r.minimizer_start, r.start, r.supermer) for r in got.collect()) == sorted((r.read_id, *x) for r in reads.collect() for x in brute(r.seq, 9, 4, rank.__getitem__))
    # sorted codes where motifs are long, and k-mers without a motif of the set
    some = spark.createDataFrame([("ACGTACGTACGT", 3), ("TTTTTTTTTTTT", 1)], "motif string, rank long")
    odd = spark.createDataFrame([(1, "ACGTACGTACGTTTTTTTTTTTTTT"), (2, "C" * 30)], "read_id long, seq string")
    left = minimizer.supermers(odd, 13, Ordering(12, "table", table=some), strict=False).collect()
    assert {r.minimizer for r in left} == {"ACGTACGTACGT", "TTTTTTTTTTTT"} and {r.read_id for r in left} == {1}
    with pytest.raises(Exception, match="no minimizer"):
        minimizer.supermers(odd, 13, Ordering(12, "table", table=some)).collect()


def exchanged(df):
    """Bytes that the exchanges of a plan wrote."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.length())]
    return total


def test_counts_with_a_third_of_the_bytes(spark):
    rnd = random.Random(7)
    reads = spark.createDataFrame([(dna(rnd, 150),) for _ in range(3000)], "seq string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain, packed_ = count_kmers(reads, 31), count_by_supermers(reads, 31, Ordering(9, "random", 12345), hot=[])
        assert 3 * exchanged(packed_) <= exchanged(plain)
        assert plan(packed_).count("Exchange") == 1
        assert sorted(map(tuple, packed_.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_keys_that_every_file_repeats_are_sent_once(spark, tmp_path, monkeypatch):
    """By the queries of super-mers and of plain counts; sequence files made of one file of keys are several."""
    d = str(tmp_path)
    for name, key, files in (("lineitem", "l_partkey", 8), ("orders", "o_custkey", 1), ("part", "p_partkey", 1)):
        for _ in range(files):
            spark.range(200).withColumnRenamed("id", key).coalesce(1).write.mode("append").parquet(f"{d}/{name}.parquet")
    monkeypatch.setattr(queries.dealt, "__defaults__", (None, 50))
    sent = packed_supermers(queries.line_reads(spark, d), queries.K, Ordering(8))
    assert {r.weight for r in sent.collect()} == {8}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        as_stored = queries.table(spark, d, "lineitem").select(queries.bases(F.col("l_partkey")).alias("seq"))
        assert 2 * exchanged(queries.kmer_count(spark, d)) < exchanged(count_kmers(as_stored, queries.K))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for path in queries._files(spark, d)[:2]:
        assert spark.read.text(path).select(F.input_file_name()).distinct().count() > 1


def test_hot_minimizers_are_split(spark):
    """A third of the k-mers have one minimizer."""
    rnd = random.Random(8)
    rows = [(dna(rnd, 40) + "A" * 12 + dna(rnd, 40) if i % 2 else dna(rnd, 60),) for i in range(4000)]
    reads = spark.createDataFrame(rows, "seq string")
    k, ordering, parts = 31, Ordering(10), 8
    hot = hot_minimizers(reads, k, ordering, fraction=0.5, parts=parts)
    assert hot == [0] or 0 in hot

    def loads(hot):
        each = cut_kmers(routed(packed_supermers(reads, k, ordering, "seq", hot), parts), k, "weight")
        found = {r[0]: r[1] for r in each.groupBy(F.spark_partition_id()).count().collect()}
        return sorted(found.get(i, 0) for i in range(parts))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        before, after = loads([]), loads(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(before) == sum(after) and before[-1] > 2 * before[parts // 2] and after[-1] <= 2 * after[parts // 2]
    want = sorted(map(tuple, count_kmers(reads, k).collect()))
    assert sorted(map(tuple, count_by_supermers(reads, k, ordering, hot=hot).collect())) == want
    assert sorted(map(tuple, count_by_supermers(reads, k, ordering).collect())) == want


def kmer_counts(seqs, k):
    return Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))


def as_dict(df):
    rows = df.collect()
    out = {r["kmer"]: r["count"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def two(spark):
    rnd = random.Random(9)
    genome = dna(rnd, 500)
    a = [genome[i : i + 60] for i in (0, 10, 25, 25, 200, 330)] + ["ACGNACGTACGTTTTACGACGACGACGT", None, "", "AC"]
    b = [genome[i : i + 45] for i in (30, 40, 210, 400)] + [dna(rnd, 80)]
    to = lambda xs: spark.createDataFrame([(x,) for x in xs], "seq string")
    parts = lambda xs: [p for x in xs if x for p in x.split("N")]
    return to(a), to(b), parts(a), parts(b)


@pytest.mark.parametrize("hot", [[], list(range(40))])
def test_stored_index(spark, two, tmp_path, hot):
    k = 13
    reads, more, a, b = two
    ca, cb = kmer_counts(a, k), kmer_counts(b, k)
    ix = SupermerIndex.of_reads(reads, k, Ordering(4, "signature"), buckets=3, hot=hot)
    ix.write(f"{tmp_path}/a")
    ix.of_more_reads(more).write(f"{tmp_path}/b")
    x, y = SupermerIndex.read(spark, f"{tmp_path}/a"), SupermerIndex.read(spark, f"{tmp_path}/b")
    assert x.params == ix.params and as_dict(x.counted()) == ca and as_dict(y.counted()) == cb
    cases = {
        ("union", "sum"): ca + cb, ("union", "max"): ca | cb, ("union", "min"): {q: min(ca.get(q, 1e9), cb.get(q, 1e9)) for q in ca | cb}, ("union", "left"): {**cb, **ca}, ("union", "right"): {**ca, **cb},
        ("intersect", "min"): ca & cb, ("intersect", "sum"): {q: ca[q] + cb[q] for q in ca & cb}, ("intersect", "left"): {q: ca[q] for q in ca & cb},
        ("subtract", "counters_subtract"): ca - cb, ("subtract", "kmers_subtract"): {q: n for q, n in ca.items() if q not in cb},
    }
    for (op, rule), want in cases.items():
        found = getattr(x, op)(y, rule)
        assert "Exchange" not in plan(found.df), op
        assert as_dict(found.counted()) == dict(want), (op, rule)
    # chains keep every k-mer once; super-mers that both sides gave are one when written
    both = x.union(y).subtract(y).union(y, "max")
    both.write(f"{tmp_path}/c")
    again = SupermerIndex.read(spark, f"{tmp_path}/c")
    assert as_dict(again.counted()) == {q: max(ca.get(q, 0), cb.get(q, 0)) for q in ca | cb}
    rows = again.df.select("minimizer", "digit", "size", "words").collect()
    assert len({(r[0], r[1], r[2], tuple(r[3])) for r in rows}) == len(rows)
    assert as_dict(x.filter_counts(2).counted()) == {q: n for q, n in ca.items() if n >= 2}
    assert as_dict(x.map_counts(lambda c: c * 3).counted()) == {q: 3 * n for q, n in ca.items()}
    assert as_dict(x.lookup(more).counted()) == {q: ca[q] for q in ca if q in cb}
    with pytest.raises(ValueError):
        x.union(y, "kmers_subtract")


def test_buckets_grow_with_the_reads(spark, tmp_path, monkeypatch):
    """And indexes of different buckets or orderings are dealt out as super-mers, not as k-mers."""
    monkeypatch.setattr(superindex, "BUCKET", 5000)
    rnd, k = random.Random(3), 13
    a, b = [dna(rnd, 40) for _ in range(300)], [dna(rnd, 40) for _ in range(1500)]
    b[:100] = a[:100]
    few, many = (spark.createDataFrame([(x,) for x in xs], "seq string").repartition(2) for xs in (a, b))
    assert superindex.buckets_for(few, k, 3, fraction=1) == 3 and superindex.buckets_for(many, k, 3, fraction=1) == 9
    monkeypatch.setattr(superindex.buckets_for, "__defaults__", ("seq", False, 1, 0))
    x = SupermerIndex.of_reads(few, k, Ordering(4), buckets=2, hot=[0])
    y = x.of_more_reads(many)
    assert (x.params.buckets, y.params.buckets) == (2, 9)
    x.write(f"{tmp_path}/x"), y.write(f"{tmp_path}/y")
    x, y = SupermerIndex.read(spark, f"{tmp_path}/x"), SupermerIndex.read(spark, f"{tmp_path}/y")
    ca, cb = kmer_counts(a, k), kmer_counts(b, k)
    for one, other, want in ((x, y, ca + cb), (y, x, ca + cb), (x, y.change_ordering(Ordering(5)), ca + cb)):
        found = one.union(other)
        assert found.params.buckets == 9 and as_dict(found.counted()) == want
        for shuffled in plan(found.df).split("Exchange hashpartitioning(")[1:]:
            assert "kmer" not in shuffled.split("),")[0]


def test_cut_anew(spark, two, tmp_path):
    k = 13
    reads, more, a, b = two
    ca, cb = kmer_counts(a, k), kmer_counts(b, k)
    x = SupermerIndex.of_reads(reads, k, Ordering(4), buckets=3, hot=[0, 1])
    for ordering in (Ordering(6, "random", 99), Ordering(3, "signature"), Ordering(2, "table", table=minimizer.shuffled(minimizer.all_motifs(spark, 2), 5))):
        y = x.change_ordering(ordering)
        assert "Aggregate" not in plan(y.df).split("MapInArrow")[0]
        assert as_dict(y.counted()) == ca
        motifs = {r.minimizer for r in y.supermers().collect()}
        assert all(len(s) == ordering.m for s in motifs)
        direct = SupermerIndex.of_reads(reads, k, ordering, hot=[])
        least = lambda df: sorted((r.minimizer, r.totalAbundance, r.distinctKmers, r.uniqueKmers, r.maxAbundance) for r in df.collect())
        assert least(y.bins()) == least(direct.bins())
        # an index by another ordering is cut anew before it is combined
        assert as_dict(y.union(SupermerIndex.of_reads(more, k, Ordering(5))).counted()) == ca + cb
    x.change_ordering(Ordering(2, "table", table=minimizer.shuffled(minimizer.all_motifs(spark, 2), 5))).repartition(2).write(f"{tmp_path}/t")
    back = SupermerIndex.read(spark, f"{tmp_path}/t")
    assert back.params.buckets == 2 and as_dict(back.counted()) == ca and back.fits(back)


def test_bins_and_size_of_the_stored_form(spark, tmp_path):
    rnd = random.Random(10)
    reads = spark.createDataFrame([(i, dna(rnd, 150)) for i in range(1500)], "read_id long, seq string")
    ordering = Ordering(9, "random", 777)
    ix = SupermerIndex.of_reads(reads, 31, ordering, buckets=4, hot=[])
    ix.write(f"{tmp_path}/s")
    count_kmers(reads, 31).write.option("compression", "zstd").parquet(f"{tmp_path}/flat")
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).glob("*.parquet"))
    assert size("s") < size("flat") / 2
    stored = SupermerIndex.read(spark, f"{tmp_path}/s").bins()
    direct = minimizer.bucket_stats(reads, 31, ordering)
    assert stored.columns == direct.columns and sorted(map(tuple, stored.select(*direct.columns[0:1], *direct.columns[2:]).collect())) == sorted(map(tuple, direct.select(*direct.columns[0:1], *direct.columns[2:]).collect()))


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([(None,), ("",), ("NNN",)], "seq string")
    assert count_by_supermers(none, 9, Ordering(3)).count() == 0
    ix = SupermerIndex.of_reads(none, 9, Ordering(3))
    assert ix.counted().count() == 0 and ix.bins().count() == 0 and ix.union(ix).counted().count() == 0
    with pytest.raises(ValueError):
        count_by_supermers(none, 8, Ordering(3), normalize=True)
    with pytest.raises(ValueError):
        ix.union(SupermerIndex.of_reads(none, 7, Ordering(3)))


def test_numbers_by_ranges(spark):
    rnd = random.Random(11)
    values = [rnd.randrange(10**6) for _ in range(5000)]
    df = spark.createDataFrame([(v, str(v)) for v in values], "v long, s string").repartition(7)
    got = numbered(df, [F.col("v")], "n", start=3)
    rows = got.collect()
    assert got.columns == ["v", "s", "n"] and [r.v for r in sorted(rows, key=lambda r: r.n)] == sorted(values) and sorted(r.n for r in rows) == list(range(3, 5003))
    assert numbered(df.where("v < 0"), [F.col("v")]).count() == 0
