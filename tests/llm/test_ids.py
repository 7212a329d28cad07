"""Ids that doubles can't hold, null ids and rows that are alike, in one batch."""

import public_tokenizers
import pytest

from strandlake.llm import bpe, fingerprints, langid, linededup, neardup, packing, runs, secrets, suffixdedup, tiers, toxicity

BIG = 9007199254740993
LONG = "many words of one very long text " * 20_000
ROWS = [(BIG, "some text of words"), (None, "another text here"), (BIG, "some text of words"), (BIG + 1, None), (None, None), (BIG + 2, ""), (BIG + 3, LONG)]


def run(name, docs):
    return {
        "fingerprints": lambda: fingerprints.fingerprint_documents(docs),
        "linededup": lambda: linededup.dedup_lines(docs),
        "bpe": lambda: bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False),
        "langid": lambda: langid.identify(docs, None),
        "neardup": lambda: neardup.near_duplicates(docs),
        "packing": lambda: packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).where("piece = 0"),
        "suffixdedup": lambda: suffixdedup.dedup_documents(docs),
        "runs": lambda: runs.digests(runs.find_runs(runs.loop_tails(docs))),
        "tiers": lambda: tiers.pack_tiers(docs, public_tokenizers.path("byte_bpe_50k.json")).where("start = 0"),
        "secrets": lambda: secrets.scan_documents(docs),
        "toxicity": lambda: toxicity.score_documents(docs, toxicity.fit([], [])),
    }[name]()


@pytest.mark.parametrize("name", ["bpe", "fingerprints", "langid", "linededup", "neardup", "packing", "runs", "secrets", "suffixdedup", "tiers", "toxicity"])
def test_ids_come_back_as_they_were(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    got = [r.doc_id for r in run(name, docs).select("doc_id").collect()]
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i))
    assert order(got) == order([i for i, _ in ROWS])
