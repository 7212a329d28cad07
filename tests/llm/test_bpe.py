import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

from strandlake.llm.bpe import SpeculativeBPE, encode_documents

from .fixtures import corpus, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>a<|endoftext|>", "don't I'll 'S", "a  b\n\n c ", "\x1c\x85\xa0 a", "²³½ 12ab", " ́e", "aaaaaaaaaaaa", "!!!'s"]


def test_same_ids_and_text_as_the_library(spark):
    texts = corpus(ODD)
    got = {r.doc_id: r for r in encode_documents(table(spark, texts), PATH).collect()}
    lib = Tokenizer.from_file(PATH)
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded == back
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert encode_documents(empty(spark), PATH).count() == 0


def test_failing_proposals_are_merged_exactly():
    with open(PATH, encoding="utf-8") as f:
        bpe = SpeculativeBPE(f.read())
    words = [" thaterndingha", " ciónquearr", "x" * 200, " éaux" * 30]
    bpe.learn(words)
    assert 0 < bpe.failed
    for w in words:
        assert bpe.cache[w] == struct.pack(f"<{len(x := bpe._exact(w.encode()))}I", *x)
