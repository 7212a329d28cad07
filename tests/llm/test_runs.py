import hashlib
import random
import re
import zlib

from strandlake.llm import runs
from strandlake.llm.runs import Stretch, digests, find_runs, loop_tails, runs_of_texts

from .fixtures import corpus, empty, table


def brute(words, periods=4, least=6):
    """All maximal stretches that a period holds for, kept for their smallest one."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n_, q) for (s, n_), q in found.items())


def looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = looped(doc_id, text)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    line = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha(line), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings(rnd):
    """Few words, often repeated: random, Fibonacci-like, and powers with a disturbance."""
    for _ in range(150):
        yield [rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(0, 60))]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    for _ in range(60):
        root = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 12))]
        s = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 9))] + (root * rnd.randint(2, 9))[: rnd.randint(1, 90)] + [rnd.randint(0, 2) for _ in range(rnd.randint(0, 9))]
        if s and rnd.random() < 0.5:
            s[rnd.randrange(len(s))] = 7
        yield s


def test_scan_finds_the_runs_of_brute_force():
    for s in strings(random.Random(2)):
        for periods, least in ((2, 2), (3, 5), (4, 6)):
            assert sorted(Stretch(s).runs(periods, least)) == brute(s, periods, least), (s, periods)


def test_texts_in_a_batch_keep_their_own_runs():
    many = list(strings(random.Random(5)))
    got = runs_of_texts([" ".join(f"w{x}" for x in s).encode() for s in many])
    for s, (found, collapsed) in zip(many, got, strict=True):
        assert sorted(found) == brute(s)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        assert collapsed.decode() == " ".join(f"w{x}" for i, x in enumerate(s) if i not in gone)


def test_words_are_compared_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(Stretch, "_same", lambda self, i, j, n: True)
    for s in list(strings(random.Random(3)))[140:180]:
        assert sorted(Stretch(s).runs(2, 2)) == brute(s, 2, 2)


def test_long_periods_and_powers_of_one_word():
    rnd = random.Random(4)
    root = [rnd.randint(0, 300) for _ in range(7000)]
    assert Stretch(root * 5 + root[:11]).runs() >= {(0, 35_011, 7000)}
    assert Stretch([0] * 60_000).runs() == {(0, 60_000, 1)}
    assert runs.stretches(*[__import__("numpy").arange(10).astype("uint64")] * 2) == []


def test_documents_against_brute_force(spark):
    loop = "sing a song of six pence "
    extra = [loop * 4, loop * 9 + "end", "x " * 7, "a b " * 4, "a b a b a b a", "one\x1cword\x85 " * 8, ("tik tok " * 5 + "stop ") * 6, " ".join(f"n{i % 50}" for i in range(400))]
    texts = corpus(extra)
    docs = table(spark, texts)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    # the long random text is too long for brute force: it holds none, looped it would be checked elsewhere
    rows = {r[0]: tuple(r) for r in digests(find_runs(loop_tails(docs))).collect()}
    assert len(rows) == len(texts)
    for i, t in zip(ids, texts, strict=True):
        if t is None or len(t) < 100_000:
            assert rows[i] == expected(i, t), (i, t)
    found = {r.doc_id: r for r in find_runs(docs).collect()}
    at = texts.index(loop * 9 + "end") + 1
    assert [tuple(r) for r in found[at].runs] == [(0, 54, 6)] and found[at].collapsed == loop + "end"


def test_odd_rows(spark):
    assert find_runs(empty(spark)).count() == 0 and digests(find_runs(loop_tails(empty(spark)))).count() == 0
    rows = [(2**53 + 1, "la " * 6), (None, "la " * 6), (2**53 + 1, "la " * 6), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS runs", "'y' AS collapsed", "1 AS period")
    got = sorted((tuple(r) for r in digests(find_runs(loop_tails(docs))).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
