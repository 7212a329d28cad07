"""Small documents with the awkward cases every operator must define."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, blob string, key string, part string"


def corpus(extra=(), seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "thing", "Étre", "wörld", "señor", "an", "it", "x1", "end."]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1] + " the", "", None, " ", "one", "one two", "\n\n", "tab\tand\x0b\x0cfeeds\r\n", "日本語 テスト 🙂", "z" * 3000, " ".join(rnd.choice(words) for _ in range(40_000))]
    return [*texts, *extra]


def table(spark, texts, first=1):
    rows = [(i + first, t, None if i % 5 == 0 else "en", None, None if t is None else len(t), "r", "w", "b", "k", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
