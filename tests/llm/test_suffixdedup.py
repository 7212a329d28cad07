import hashlib
import random
from collections import Counter

from strandlake.llm.suffixdedup import dedup_documents

from .fixtures import corpus, empty, table


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(width):
    rnd = random.Random(11)
    fresh = lambda n: "".join(rnd.choice("abcdé fgh") for _ in range(n))
    p, q = fresh(2 * width), fresh(width + 1)
    near = fresh(6 * width)
    return [
        fresh(50) + p + fresh(30), p[3:] + fresh(20), fresh(9) + p[: width + 4] + "X" + p[width + 5 :], "ab" * width, fresh(10) + "ab" * width,
        q + fresh(7) + q, q[: width - 1], near, near[: 3 * width] + "Z" + near[3 * width :], near[:width] + near[2 * width :], near, fresh(width) + near[width : 2 * width + 1],
    ]


def check(spark, texts, width, **more):
    got = {r.doc_id: r for r in dedup_documents(table(spark, texts), width, with_text=True, **more).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, width), 1):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want, i


def test_same_as_brute_force(spark):
    check(spark, passages(40), 40)


def test_awkward_rows_and_crowded_anchors(spark):
    check(spark, [*corpus(), *passages(40)], 40, crowd=1)
    assert dedup_documents(empty(spark)).count() == 0
