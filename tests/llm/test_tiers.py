import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm.tiers import TIERS, pack, pack_tiers, step_groups

from .fixtures import corpus, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def covered(lengths, sequences):
    """Every token once, all sequences full and of powers of two."""
    spans = defaultdict(list)
    for size, pieces in sequences:
        assert size & (size - 1) == 0 and sum(n for _, _, n in pieces) == size <= max(TIERS)
        for d, start, n in pieces:
            assert n > 0
            spans[d].append((start, n))
    for d, length in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[d]):
            assert start == at
            at += n
        assert at == length


def test_every_token_once_and_no_padding():
    rnd = random.Random(1)
    for _ in range(200):
        lengths = [rnd.choice([1, 2, rnd.randint(1, 40), rnd.randint(1, 700), rnd.randint(900, 5000), 1024, 128, 129]) for _ in range(rnd.randint(0, 60))]
        covered(lengths, pack(lengths))
    covered([1023], pack([1023]))
    assert sorted(s for s, _ in pack([1023])) == [2**i for i in range(10)]
    assert pack([]) == [] and pack([4096]) == [(1024, [(0, i, 1024)]) for i in range(0, 4096, 1024)]


def test_long_gaps_are_filled_from_shorter_tiers():
    # 900 + 100 + 24 fill a window whole; 300 and 212 fill one of 512
    got = pack([900, 100, 24, 300, 212])
    assert sorted((s, sorted(n for _, _, n in p)) for s, p in got) == [(512, [212, 300]), (1024, [24, 100, 900])]
    rnd = random.Random(2)
    lengths = [min(1024, int(rnd.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    got = pack(lengths)
    pieces = sum(len(p) for _, p in got)
    # documents cut are at most one for each window
    assert pieces - len(lengths) <= len(got)
    assert {s for s, _ in got} >= set(TIERS)


def test_step_groups_are_alike():
    rnd = random.Random(3)
    sequences = pack([rnd.randint(1, 1500) for _ in range(4000)])
    groups = step_groups(sequences)
    tokens, cost, count = defaultdict(int), defaultdict(int), defaultdict(set)
    for (size, pieces), g in zip(sequences, groups, strict=True):
        tokens[g] += size
        cost[g] += sum(n * n for _, _, n in pieces)
        count[g].add(size)
    assert set(groups) == set(range(max(groups) + 1)) and all(len(x) == 1 for x in count.values())
    for size in TIERS:
        mine = [g for g in tokens if count[g] == {size}]
        assert max(tokens[g] for g in mine) <= 1 << 15 and max(tokens[g] for g in mine) - min(tokens[g] for g in mine) <= size
        assert max(cost[g] for g in mine) <= 1.02 * min(cost[g] for g in mine) + size * size


@pytest.mark.parametrize("shard", [1 << 21, 700])
def test_documents_come_back_from_their_pieces(spark, shard):
    texts = corpus(["<|endoftext|>A b", "don't stop", "x" * 30_000])
    lib = Tokenizer.from_file(PATH)
    rows = pack_tiers(table(spark, texts), PATH, shard=shard, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts, 1):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and list(r.ids) == ids[at : at + r.length] and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].tier and at & (at - 1) == 0 and at <= 1024 and len({r.step_group for r in parts}) == 1


def test_odd_rows(spark):
    assert pack_tiers(empty(spark), PATH).count() == 0
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, "a b"), (2**53 + 1, "a b"), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS tier", "2 AS start").coalesce(1)
    got = pack_tiers(docs, PATH).collect()
    whole = defaultdict(int)
    for r in got:
        whole[r.doc_id] += r.length
    assert whole == {None: 4, 2**53 + 1: 6}
    with pytest.raises(ValueError):
        pack_tiers(docs, PATH, tiers=(100,))
