import json
import random

import pytest

from strandlake.sources import ranges, sequences
from strandlake.sources.ranges import RangeReader


def rows(mode, path, split, k=5, index=None):
    size = path.stat().st_size
    reader = RangeReader({"mode": mode, "files": json.dumps([[f"file:{path}", size, index and f"file:{index}"]]), "split": str(split), "k": str(k)})
    return [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]


def dna(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def kmers(seqs, k):
    return sorted(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("tail", ["", "x", "xx"])
def test_fastq_by_ranges_of_every_size(tmp_path, end, tail):
    rnd = random.Random(1)
    want, text = [], []
    for i in range(12):
        seq = dna(rnd, rnd.choice([1, 4, 9]))
        quality = rnd.choice(["@", "+", "I", "@+"[i % 2] * 2]) + "".join(rnd.choice("@+IJ") for _ in range(len(seq)))
        want.append((f"r{i} of it", f"r{i}", seq))
        text += [f"@r{i} of it", seq, "+" + f"r{i} of it" * (i % 2), quality[: len(seq)]]
    path = tmp_path / "a.fastq"
    path.write_bytes((end.join(text) + end * len(tail)).encode())
    for split in [*range(1, 60), 97, 10_000]:
        got = [(r["title"], r["header"], r["nucleotides"]) for r in rows("fastq", path, split)]
        assert got == want, split


def test_broken_fastq_is_an_error(tmp_path):
    for text in ("no record at all\nACGT\n", "@a\nACGT\n+\nIIII\n@b\nAC\n", "@a\nACGT\n+\nIIII\nb\nAC\n+\nII\n"):
        path = tmp_path / "b.fastq"
        path.write_text(text)
        with pytest.raises(ValueError):
            rows("fastq", path, 1000)


def fasta_text(rnd, records, end, width, last_end):
    lines = []
    for title, seq in records:
        lines.append(">" + title)
        lines += [seq[i : i + width] for i in range(0, len(seq), width)]
        if rnd.random() < 0.3:
            lines.append("")
    return end.join(lines) + (end if last_end else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_fasta_by_ranges_of_every_size(tmp_path, end, width):
    rnd = random.Random(2)
    k = 5
    records = [(f"s{i} {'x' * rnd.randint(0, 9)}", dna(rnd, rnd.choice([0, 1, 3, 20, 61]))) for i in range(9)]
    for last_end in (True, False):
        path = tmp_path / "a.fasta"
        path.write_bytes(fasta_text(rnd, records, end, width, last_end).encode())
        for split in [*range(1, 40), 57, 10_000]:
            segments = rows("segments", path, split)
            place, title, seen = {}, None, 0
            total = {}
            for s in segments:
                if s["title"] is not None:
                    title, seen = s["title"], 0
                    total[title] = 0
                else:
                    place[s["range"]] = (title, seen)
                seen += s["bases"]
                total[title] += s["bases"]
            assert total == {t.strip(): len(s) for t, s in records}, split
            found = {t.strip(): {} for t, _ in records}
            for p in rows("pieces", path, split, k):
                t, before = (p["title"], 0) if p["title"] is not None else place[p["range"]]
                for i in range(len(p["nucleotides"]) - k + 1):
                    at = before + p["at"] + i
                    assert at not in found[t], (split, t, at)
                    found[t][at] = p["nucleotides"][i : i + k]
            assert found == {t.strip(): {i: s[i : i + k] for i in range(len(s) - k + 1)} for t, s in records}, split


def test_pieces_of_a_segment(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 7)
    rnd = random.Random(3)
    seq = dna(rnd, 100)
    path = tmp_path / "a.fasta"
    path.write_text(">a\n" + seq + "\n")
    got = rows("pieces", path, 1000)
    assert [p["at"] for p in got] == list(range(0, 100, 7)) and kmers([p["nucleotides"] for p in got], 5) == kmers([seq], 5)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_indexed_fasta_by_bases(tmp_path, end):
    rnd = random.Random(4)
    records = [(f"c{i}", dna(rnd, n)) for i, n in enumerate((50, 1, 23, 8, 400, 3))]
    path, index, lines, at = tmp_path / "a.fasta", tmp_path / "a.fasta.fai", b"", []
    for title, seq in records:
        lines += f">{title} long{end}".encode()
        at.append(f"{title}\t{len(seq)}\t{len(lines)}\t10\t{10 + len(end)}")
        for i in range(0, len(seq), 10):
            lines += (seq[i : i + 10] + end).encode()
    path.write_bytes(lines)
    index.write_text("\n".join(at) + "\n")
    for split in (1, 3, 10, 11, 64, 10_000):
        got = rows("fai", path, split, 5, index)
        assert kmers([r["nucleotides"] for r in got], 5) == kmers([s for _, s in records], 5)
        for r in got:
            seq = dict(records)[r["title"]]
            assert seq[r["location"] - 1 :].startswith(r["nucleotides"]) and len(r["nucleotides"]) <= min(split, ranges.PIECE) + 4
    # short sequences share a task
    assert len(ranges.fai_stretches(index.read_text(), 1000)) == 1
    index.write_text("c0\t5000\t9\t10\t11\n")
    with pytest.raises(ValueError):
        rows("fai", path, 10_000, 5, index)


def test_readers_with_spark(spark, tmp_path):
    rnd = random.Random(5)
    folder = tmp_path / "many.fasta"
    folder.mkdir()
    records = {f"{f}{i}": dna(rnd, n) for f in "ab" for i, n in enumerate((70, 500, 33))}
    for f in "ab":
        (folder / f"{f}.fasta").write_text("".join(f">{t} title of {t}\n" + "".join(s[i : i + 25] + "\n" for i in range(0, len(s), 25)) for t, s in records.items() if t[0] == f))
    (folder / "_SUCCESS").write_text("")
    k = 9
    for split in (40, 10_000):
        got = sequences.read_fasta_pieces(spark, str(folder), k, split).collect()
        assert kmers([r.nucleotides for r in got], k) == kmers(records.values(), k)
        assert all(records[r.header][r.location - 1 :].startswith(r.nucleotides) and r.title == f"{r.header} title of {r.header}" for r in got)
        assert len(got) > 6 if split == 40 else len(got) == 6
        index = sequences.build_fai(spark, str(folder), split)
        assert sorted((r.id, r.length, r.bpsPerLine, r.bytesPerLine) for r in index.collect()) == sorted((t, len(s), 25, 26) for t, s in records.items())
        sequences.write_fai(spark, str(folder), split)
        df = sequences.read_long_fasta(spark, str(folder), k, split)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert kmers([r.nucleotides for r in df.collect()], k) == kmers(records.values(), k)
    # a single file with an index of one file beside it; its name finds it
    one = folder / "a.fasta"
    rows_ = [r for r in sequences.build_fai(spark, str(one)).orderBy("start").collect()]
    (folder / "a.fasta.fai").write_text("".join(f"{r.id}\t{r.length}\t{r.start}\t{r.bpsPerLine}\t{r.bytesPerLine}\n" for r in rows_))
    found = sequences.read_sequences(spark, [str(one)], k).collect()
    assert sorted((r.title, r.location, r.nucleotides) for r in found) == sorted((t, 1, s) for t, s in records.items() if t[0] == "a")


def test_a_long_record_comes_out_in_many_tasks(spark, tmp_path):
    rnd = random.Random(6)
    block = dna(rnd, 50_000)
    path = tmp_path / "long.fasta"
    with open(path, "w") as f:
        f.write(">one\n")
        for _ in range(200):
            f.write(block + "\n")
    k = 21
    df = sequences.read_fasta_pieces(spark, str(path), k, 1 << 20)
    assert df.rdd.getNumPartitions() == 10
    lengths = [(r[0], r[1]) for r in df.selectExpr("location", "length(nucleotides)").collect()]
    assert sum(n - k + 1 for _, n in lengths) == 10_000_000 - k + 1 and len(lengths) >= 10
    whole = block * 2
    counts = {}
    for i in range(50_000):
        counts[whole[i : i + k]] = counts.get(whole[i : i + k], 0) + 1
    from strandlake.operators.superindex import count_by_supermers

    got = count_by_supermers(df.selectExpr("nucleotides AS seq"), k).where("count > 1")
    assert got.count() == len(counts)
    low = 199
    assert got.where(f"count < {low}").count() == 0


def test_compressed_fastq_goes_by_lines(spark, tmp_path):
    import gzip

    text = "@a 1\nACGT\n+\n@III\n@b 2\nGG\n+\n+@\n"
    with gzip.open(tmp_path / "x.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "y.fastq").write_text(text)
    both = [sorted(map(tuple, sequences.read_fastq(spark, str(tmp_path / n)).collect())) for n in ("x.fastq.gz", "y.fastq")]
    assert both[0] == both[1] == [("a 1", "a", 1, "ACGT"), ("b 2", "b", 1, "GG")]
    assert "Exchange" not in sequences.read_fastq(spark, str(tmp_path / "y.fastq"), 7)._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "z.fastq").write_text("")
    assert sequences.read_fastq(spark, str(tmp_path / "z.fastq")).count() == 0
    with pytest.raises(FileNotFoundError):
        sequences.read_fastq(spark, str(tmp_path / "none.fastq"))


def test_short_ranges_share_tasks(tmp_path, monkeypatch):
    from strandlake.sources import ranges

    path = tmp_path / "many.fastq"
    path.write_text("".join(f"@r{i}\n{'ACGT' * 8}\n+\n@{'I' * 31}\n" for i in range(5000)))
    size = path.stat().st_size
    reader = RangeReader({"mode": "fastq", "files": json.dumps([[f"file:{path}", size, None]]), "split": "100"})
    parts = reader.partitions()
    assert size // 100 > 10 * len(parts) and len(parts) <= ranges.TASKS
    got = [r["title"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [f"r{i}" for i in range(5000)]
    # a long range is split in steps
    monkeypatch.setattr(ranges, "STEP", 999)
    one = RangeReader({"mode": "fastq", "files": json.dumps([[f"file:{path}", size, None]]), "split": str(size)})
    batches = [b for p in one.partitions() for b in one.read(p)]
    assert len(batches) > 300 and [r["title"] for b in batches for r in b.to_pylist()] == got


def test_short_indexed_sequences_share_tasks(tmp_path):
    from strandlake.sources import ranges

    rnd = random.Random(7)
    records = [(f"c{i}", dna(rnd, 130)) for i in range(3000)]
    path, index, lines, at = tmp_path / "a.fasta", tmp_path / "a.fasta.fai", b"", []
    for title, seq in records:
        lines += f">{title}\n".encode()
        at.append(f"{title}\t{len(seq)}\t{len(lines)}\t130\t131\n")
        lines += seq.encode() + b"\n"
    path.write_bytes(lines)
    index.write_text("".join(at))
    reader = RangeReader({"mode": "fai", "files": json.dumps([[f"file:{path}", len(lines), f"file:{index}"]]), "split": "100", "k": "5"})
    parts = reader.partitions()
    assert len(parts) <= ranges.TASKS
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert kmers([r["nucleotides"] for r in got], 5) == kmers([s for _, s in records], 5)
