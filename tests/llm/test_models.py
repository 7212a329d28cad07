import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import langid, toxicity

from .fixtures import corpus, empty, table

TONGUES = {"aa": ["kalo", "mika", "tano", "leri"], "bb": ["schröd", "zwicht", "pfumm", "grütz"], "cc": ["queño", "señi", "lluvo", "jaque"]}


def sentence(rnd, tongue, n):
    return " ".join(rnd.choice(TONGUES[tongue]) for _ in range(n))


def spoken(spark, n=240):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        t = rnd.choice(list(TONGUES))
        rows.append((i, sentence(rnd, t, rnd.randint(3, 60)), t if i % 7 else None, t))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spoken(spark)
    got = langid.identify(docs, langid.learn(docs)).join(docs, "doc_id").collect()
    assert len(got) == 240 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == r.truth for r in held]) > 0.97


def test_windows_pool_over_the_whole_text(spark):
    rnd = random.Random(1)
    texts = [sentence(rnd, t, 200).encode() for t in TONGUES for _ in range(20)]
    model = langid.train(texts, [t for t in TONGUES for _ in range(20)], steps=60)
    mixed = (sentence(rnd, "aa", 400) + " " + sentence(rnd, "bb", 100)).encode()
    p = langid.pooled(model, [mixed, b"", mixed * 3])
    assert p[0].argmax() == 0 and p[0][1] > 0.1 and abs(p[0].sum() - 1) < 1e-5
    assert not p[1].any() and np.abs(p[2] - p[0]).max() < 0.05
    # the quick reader is the trained cell
    seq = np.frombuffer(mixed[:96], np.uint8).reshape(2, 48)
    f, _ = langid._forward(model.cells[0], seq.T.astype(int))
    b, _ = langid._forward(model.cells[1], seq.T[::-1].astype(int))
    logits = np.concatenate([f, b[::-1]], 2) @ model.out + model.bias
    e = np.exp(logits)
    assert np.abs((e / e.sum(2, keepdims=True)).sum(0) - langid.Reader(model).label(seq.astype(np.int16), np.array([48, 48]))).max() < 1e-3


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = langid._start(["a", "b"], 3)
    cell = {k: v.astype(np.float64) for k, v in model.cells[0].items()}
    seq = rng.integers(0, 256, (6, 4))
    weights = rng.normal(size=(6, 4, langid.HIDDEN))
    loss = lambda: float((np.stack(langid._forward(cell, seq)[0]) * weights).sum())
    states, kept = langid._forward(cell, seq)
    grad = langid._backward(cell, seq, kept, weights)
    for name, at in (("u", (2, 5)), ("u", (1, 20)), ("x", (seq[0, 0], 3)), ("x", (seq[3, 1], 18))):
        old = cell[name][at]
        cell[name][at] = old + 1e-3
        up = loss()
        cell[name][at] = old - 1e-3
        down = loss()
        cell[name][at] = old
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


def test_awkward_rows_of_languages(spark):
    docs = table(spark, corpus())
    out = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    for i, t in enumerate(corpus(), 1):
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    nothing = langid.learn(empty(spark))
    assert nothing is None and {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, langid.learn(docs), 0.5)
    assert kept.columns == docs.columns and kept.where(~F.col("text").rlike(r"\p{L}") | F.col("text").isNull()).count() == 0
    assert langid.identify(empty(spark), None).count() == 0


def test_toxic_documents_are_found(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice("the of to and in that house tree river stone cloud green".split()) for _ in range(rnd.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words) + 1), rnd.choice(["blarg", "snorf", "gruntiä", "gruntoll", "gruntix", "sn0rf"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, toxicity.learn(docs, marks)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98


def test_awkward_rows_of_toxicity(spark):
    docs = table(spark, corpus())
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (2, 1), (4, 0), (6, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, toxicity.learn(docs, marks)).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 for r in out)
    for few in ([(1, 0), (2, 1)], [(1, 0), (2, 1), (3, 0), (4, 1)], [(1, 0), (2, 0), (3, 0), (4, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(few, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, model).collect())
    for some in (marks.where("toxic = 0"), marks.where("toxic > 5")):
        assert {r.score for r in toxicity.score_documents(docs, toxicity.learn(docs, some)).collect()} == {0.0}
    assert toxicity.score_documents(empty(spark), toxicity.learn(empty(spark), marks)).count() == 0


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(4)
    s, y = rng.normal(size=200), rng.integers(0, 2, 200).astype(float)
    x, p = toxicity.isotonic(s, y, np.ones(200))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(s, x, p).mean() - y.mean()) < 1e-9


def test_more_labels_than_rows_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i:03d}") for i in range(40)], "doc_id long, text string, lang string")
    try:
        langid.learn(docs, rows=5)
    except ValueError as e:
        assert "labels" in str(e)
    else:
        raise AssertionError("labels were left out")
