import random
import re
from itertools import combinations

import xxhash

from strandlake.llm import neardup as N

from .fixtures import corpus, empty, table


def fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, link):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if link(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_classes_by_brute_force(spark):
    texts = corpus(["THE of", "the OF", "the of"])
    got = {r.doc_id: r for r in N.near_duplicates(table(spark, texts)).withColumn("hex", N.hex64(N.F.col("fp"))).collect()}
    fps = {i: fingerprint(t) for i, t in enumerate(texts, 1)}
    assert {i: int(r.hex, 16) for i, r in got.items()} == fps
    want = classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want
    assert N.near_duplicates(empty(spark)).count() == 0


def test_no_link_is_lost_also_in_crowded_keys(spark):
    rnd = random.Random(5)
    near = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        near.add(c)
        for _ in range(60):
            near.add(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(8)))
    fps = [x - (1 << 64) if x >> 63 else x for x in near]
    mask = (1 << 64) - 1
    found = N.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    edges = [(r.u, r.v) for r in found.collect()]
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    linked = set(edges) | {(b, a) for a, b in edges}
    assert classes(sorted(fps), lambda a, b: ((a ^ b) & mask).bit_count() <= 2) == classes(sorted(fps), lambda a, b: (a, b) in linked)
    roots = {r.u: r.root for r in N.components(found).collect()}
    want = classes(sorted(fps), lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    assert all(roots.get(x, x) == want[x] for x in fps)


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else []))


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def with_changed_words(seed=8):
    rnd = random.Random(seed)
    texts = []
    for n in (1, 4, 5, 9, 60, 120, 400):
        base = [f"w{rnd.randrange(900)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(changes):
                words[rnd.randrange(n)] = f"x{rnd.randrange(900)}"
            texts.append(" ".join(words))
    return texts


def test_similar_documents_by_brute_force(spark):
    texts = corpus(["THE of", "the OF", *with_changed_words()])
    sets = {i: shingle_set(t) for i, t in enumerate(texts, 1)}
    want = classes(list(sets), lambda a, b: alike(sets[a], sets[b]))
    far = [(a, b) for a, b in combinations(sets, 2) if sets[a] != sets[b] and alike(sets[a], sets[b]) and (fingerprint(texts[a - 1]) ^ fingerprint(texts[b - 1])).bit_count() > 2]
    assert far
    for crowd in (N.CROWD, 2):
        assert {r.doc_id: r.component_id for r in N.similar_documents(table(spark, texts), crowd=crowd).collect()} == want
    assert N.similar_documents(empty(spark)).count() == 0


def test_pipeline_stage_drops_documents_with_changed_words(spark, tmp_path):
    import corpus_pipeline as C

    texts = with_changed_words()
    sets = {i: shingle_set(t) for i, t in enumerate(texts, 1)}
    want = {i for i, root in classes(list(sets), lambda a, b: alike(sets[a], sets[b])).items() if i == root}
    assert {r.doc_id for r in C.simhash_near_dedup(spark, table(spark, texts), str(tmp_path)).collect()} == want


def test_components_of_few_edges_need_no_shuffle(spark, monkeypatch):
    from strandlake.llm import common

    edges = [(1, 2), (2, 3), (5, 4), (9, 5), (7, 7), (3, 1)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4}
    out = common.components(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.u: r.root for r in out.collect()} == want
    monkeypatch.setattr(common, "FEW", 0)
    assert {r.u: r.root for r in common.components(df).collect()} == want


def test_pipeline_stage_goes_through_simhash_classes(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rnd = random.Random(4)
    words = [f"w{rnd.randrange(900)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:40]), " ".join([*words[:39], "other"])]
    assert (fingerprint(texts[0], 5) ^ fingerprint(texts[1], 5)).bit_count() <= 2 < (fingerprint(texts[2], 5) ^ fingerprint(texts[3], 5)).bit_count()
    shingles, tried, classes_of, alike_of = [], [], N.near_duplicates, N._alike
    monkeypatch.setattr(N, "near_duplicates", lambda docs, shingle: shingles.append(shingle) or classes_of(docs, shingle))
    monkeypatch.setattr(N, "_alike", lambda pairs, *how: tried.append(pairs.count()) or alike_of(pairs, *how))
    assert {r.doc_id for r in C.simhash_near_dedup(spark, table(spark, texts), str(tmp_path)).collect()} == {1, 3}
    assert shingles == [5] and tried[0] == 1


def test_texts_are_cut_into_shingles_once(spark, monkeypatch):
    texts = corpus([*with_changed_words()])
    sets = {i: shingle_set(t) for i, t in enumerate(texts, 1)}
    cut, hashes_of = [], N.shingle_hashes
    monkeypatch.setattr(N, "shingle_hashes", lambda text, size: cut.append(size) or hashes_of(text, size))
    got = {r.doc_id: r.component_id for r in N.similar_documents(table(spark, texts)).collect()}
    assert cut == [5] and got == classes(list(sets), lambda a, b: alike(sets[a], sets[b]))
