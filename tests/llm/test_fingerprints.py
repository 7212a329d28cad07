import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from strandlake.llm import fingerprints as P

from .fixtures import corpus, empty, table


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else [])
    hi = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    lo = [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42) for h in hi]
    half = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return f"{half(hi):016x}{half(lo):016x}"


def test_by_brute_force_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE", 7)
    texts = corpus()
    docs = table(spark, texts, first=-3).withColumn("doc_id", F.when(F.col("doc_id") > 10, F.col("doc_id") + 900).otherwise(F.col("doc_id")))
    ids = [i - 3 if i - 3 <= 10 else i + 897 for i in range(len(texts))]
    by = sorted(zip(ids, [t or "" for t in texts], strict=True), reverse=True)
    got = {r.doc_id: r for r in P.fingerprint_documents(docs).collect()}
    assert len(got) == len(texts)
    fps = {i: fingerprint(t) for i, t in by}
    for n, (i, t) in enumerate(by):
        following = by[(n + 1) % len(by)]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[1][:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.fingerprint == fps[i] and r.edited_fingerprint == fingerprint(edited), i
        near = lambda a, b: max(0.0, math.cos(math.pi / 128 * (int(a, 16) ^ int(b, 16)).bit_count()))
        assert abs(r.near_edited - near(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - near(r.fingerprint, fps[following[0]])) < 1e-9
        assert r.n_within == len({x for x in fps.values() if x != fps[i] and (int(x, 16) ^ int(fps[i], 16)).bit_count() <= 3})
    assert P.fingerprint_documents(empty(spark)).count() == 0
    one = P.fingerprint_documents(table(spark, ["one two three"])).first()
    assert one.near_next == 1.0
    twins = P.fingerprint_documents(table(spark, ["a b"]).unionAll(table(spark, ["a b"]))).collect()
    assert len(twins) == 2


def test_tables_find_every_pair_within_the_radius(spark):
    rnd = random.Random(8)
    fps = set()
    for _ in range(4):
        c = rnd.getrandbits(128)
        for _ in range(50):
            x = c
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(128)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = {(signed(x >> 64), signed(x & (1 << 64) - 1)): x for x in fps}
    got = P.near_pairs(spark.createDataFrame(list(split), "hi long, lo long")).collect()
    pairs = {frozenset((split[r.hi, r.lo], split[r.bhi, r.blo])) for r in got}
    assert pairs == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3} and len(got) == len(pairs)
