import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandlake.llm.packing import _Search, best_fit, pack, pack_documents

from .fixtures import corpus, empty, table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|startoftext|>A b", "İstanbul ΣΑΣ ǅ", "don't I'LL", "\x1c\x85 a", "²³½ 12ab", " ́e É"]


def test_every_piece_once_and_no_overlap(spark):
    texts = corpus(ODD)
    lib = Tokenizer.from_file(PATH)
    for shard in (40_000, 7):
        rows = pack_documents(table(spark, texts), PATH, shard=shard).collect()
        by_doc, by_bin = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_bin[r.sequence_id].append((r.offset, r.length))
        assert len(by_doc) == len(texts)
        for i, t in enumerate(texts, 1):
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
            parts = sorted(by_doc[i], key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
            for r in parts:
                assert r.start == r.piece * 2048 and r.length == min(2048, len(ids) - r.start)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        for spans in by_bin.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
    assert pack_documents(empty(spark), PATH).count() == 0


def test_swaps_raise_squared_fill_and_save_bins():
    rnd = random.Random(1)
    saved = 0
    for _ in range(30):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 120))]
        bins = best_fit(sizes, 100)
        before = len(bins)
        fills = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
        start = fills(bins)
        search = _Search([list(b) for b in bins], sizes, 100)
        search.run()
        assert fills(search.bins) >= start
        out = pack(sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in out)
        assert -(-sum(sizes) // 100) <= len(out) <= before
        saved += before - len(out)
    # best fit decreasing wastes a bin here, exchanges don't
    sizes = [22, 21, 19, 21, 39, 34, 49, 26, 32, 26, 23, 37, 44, 17, 23, 41, 46, 36, 31, 31, 50, 43, 39, 40, 31, 35]
    assert len(best_fit(sizes, 100)) == 10 and len(pack(sizes, 100)) == 9 and saved >= 0
