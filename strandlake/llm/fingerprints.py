"""Document fingerprints: SimHash of word shingles, and block tables that find near ones.

Terms are the five-word shingles of the lower-cased text, weighted by how often they occur:
each occurrence votes on 128 signed bits, and a bit is set if the votes for it outweigh
those against. Fingerprints within ``radius`` bits agree on all but ``radius`` of the blocks
they are cut into, so a table for each choice of agreeing blocks meets every such pair.

Everything is DataFrame functions. The neighbour in descending doc_id comes from windows over
fixed ranges of ids; the head of each range also goes to the range before it, so no task
sees more than a range of rows.

Defined results: null text is the empty text; texts without words have fingerprint zero;
equal texts have equal fingerprints; rows with equal doc_id follow each other by their text;
null doc_ids come last; a single row is its own neighbour; no rows, no result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, spool, text_or_empty
from .neardup import CHUNK, hex64, shingle_hashes, votes

SHINGLE = 5
RADIUS = 3
BLOCKS = 5
#: doc_ids of one window.
RANGE = 512
#: Fingerprints of a block key above which the key is refined by further blocks.
CROWD = 16


def likeness(distance: Column) -> Column:
    """Cosine that a Hamming distance of 128 bits stands for, 0 if opposed."""
    return F.greatest(F.cos(distance * F.lit(3.141592653589793 / 128)), F.lit(0.0))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints kept as ``_hi`` and ``_lo``."""
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def simhash(rows: DataFrame, keys: list[str], text: str, shingle: int = SHINGLE) -> DataFrame:
    """``keys, hi, lo``: the fingerprint of every row; keys tell rows apart."""
    each = rows.select(*keys, F.posexplode_outer(shingle_hashes(F.col(text), shingle)).alias("at", "h"))
    halves = []
    hi, lo = F.coalesce("h", F.lit(0).cast("long")), F.coalesce(F.xxhash64("h"), F.lit(0).cast("long"))
    for name, h in (("hi", hi), ("lo", lo)):
        halves += [v.alias(f"{name}{j}") for j, v in enumerate(votes(F.when(F.col("h").isNotNull(), h).otherwise(F.lit(0).cast("long"))))]
    part = each.groupBy(*keys, F.floor(F.coalesce("at", F.lit(0)) / CHUNK).alias("chunk")).agg(F.count("h").alias("n"), *halves)
    # one more row per 32,000 shingles at most; the counters are unpacked and added up
    out = part.groupBy(*keys).agg(F.sum("n").alias("n"), *_unpacked("hi"), *_unpacked("lo"))
    return out.select(*keys, _signs("hi").alias("hi"), _signs("lo").alias("lo"))


def _unpacked(name: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(f"{name}{j}", 16 * q).bitwiseAND(F.lit(0xFFFF))).alias(f"{name}b{j + 16 * q}") for j in range(16) for q in range(4)]


def _signs(name: str) -> Column:
    out = F.lit(0).cast("long")
    for b in range(64):
        bit = F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
        out = out.bitwiseOR(F.when(F.col(f"{name}b{b}") * 2 > F.col("n"), bit).otherwise(F.lit(0).cast("long")))
    return out


def _heads(rows: DataFrame) -> DataFrame:
    """``head, goes_to``: the largest doc_id of each range and the next higher range that has rows (of the highest: the lowest)."""
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))
    placed = cut(heads.orderBy(F.asc_nulls_first("range")).select("range", "head", F.monotonically_increasing_id().alias("at")))
    # places within a partition follow each other; a partition's last looks at the next one's first
    after = placed.select((F.col("at") - 1).alias("at_before"), F.col("range").alias("higher"))
    firsts = placed.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0).select(F.shiftright("at", 33).alias("part"), F.col("range").alias("first"))
    by_part = Window.orderBy("part")
    # as many rows as partitions
    firsts = firsts.select("part", F.lead("first").over(by_part).alias("next_first"), F.lead("part").over(by_part).isNotNull().alias("has_next"), F.first("first").over(by_part).alias("lowest"))
    joined = placed.join(after, placed.at == after.at_before, "left").join(F.broadcast(firsts), F.shiftright("at", 33) == F.col("part"))
    goes_to = F.when(F.col("at_before").isNotNull(), F.col("higher")).when(F.col("has_next"), F.col("next_first")).otherwise(F.col("lowest"))
    return joined.select("head", goes_to.alias("goes_to"))


def with_next(docs: DataFrame) -> DataFrame:
    """``range, extra, doc_id, text, next``: every row with the text of the next one in descending doc_id.

    Rows with ``extra`` 1 are the copies of range heads that closed another range.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("range", F.floor(F.col("doc_id") / RANGE))
    heads = small_side(_heads(base.select("range", "doc_id")))
    copies = base.drop("range").join(heads, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("goes_to").alias("range"), F.lit(1).alias("extra"))
    rows = base.withColumn("extra", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), "text")
    return rows.select("range", "extra", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited(text: Column, following: Column) -> Column:
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of all texts and their edited texts, their likeness, and how many other fingerprints are near.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_within`` (distinct fingerprints of other texts within ``radius`` bits).
    """
    rows = with_next(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("edit", F.when(F.col("extra") == 0, edited(F.col("text"), F.col("next"))))
    keys = ["range", "extra", "doc_id", "row", "n_chars", "edited_sha256"]
    texts = rows.select(
        "range", "extra", "doc_id", "row", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edit").alias("text")))).alias("t"),
    ).select(*keys, "t.which", "t.text").where("text is not null")
    each = simhash(texts, [*keys, "which"], "text")
    side = lambda w, name: [F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{name}{c}") for c in ("hi", "lo")]
    both = each.groupBy(*keys).agg(*side(0, ""), *side(1, "e"))
    order = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("doc_id"), "row")
    both = both.select("*", F.lead("hi").over(order).alias("xhi"), F.lead("lo").over(order).alias("xlo")).where("extra = 0")
    out = spool(
        both.select(
            "doc_id", "n_chars", "edited_sha256", "hi", "lo",
            F.concat(hex64(F.col("hi")), hex64(F.col("lo"))).alias("fingerprint"),
            F.concat(hex64(F.col("ehi")), hex64(F.col("elo"))).alias("edited_fingerprint"),
            likeness(distance("", "e")).alias("near_edited"),
            likeness(distance("", "x")).alias("near_next"),
        )
    )
    pairs = near_pairs(out.select("hi", "lo").distinct(), radius)
    ends = pairs.select("hi", "lo").unionAll(pairs.select(F.col("bhi").alias("hi"), F.col("blo").alias("lo")))
    counts = ends.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    return out.join(counts, ["hi", "lo"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("n", F.lit(0).cast("long")).alias("n_within")
    )


def _bits(hi: Column, lo: Column, places: list[int]) -> Column:
    """A hash key of the bits at ``places`` (127 is the highest), kept as they are in two masked longs."""
    masks = [0, 0]
    for p in places:
        masks[p // 64] |= 1 << (p % 64)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.struct(hi.bitwiseAND(F.lit(signed[1]).cast("long")).alias("a"), lo.bitwiseAND(F.lit(signed[0]).cast("long")).alias("b"))


def block_tables(places: list[int], radius: int, blocks: int = BLOCKS) -> list[list[int]]:
    """The bits of each table's key: one table for each choice of ``blocks - radius`` blocks, dealt in turn."""
    if not 0 < radius < blocks:
        raise ValueError("there must be more blocks than differing bits")
    return [sorted(p for b in chosen for p in places[b::blocks]) for chosen in combinations(range(blocks), blocks - radius)]


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs ``hi, lo, bhi, blo`` of distinct fingerprints ``fps(hi, lo)`` within ``radius`` bits, each once.

    Keys that more than ``CROWD`` fingerprints share are refined: the bits that are left are
    cut into blocks in the same way, and a further choice of them must agree too. That loses
    no pair, and what still meets differs only in the last few blocks.
    """
    first = block_tables(list(range(128)), radius, blocks)
    hi, lo = F.col("hi"), F.col("lo")
    keyed = spool(fps.select("hi", "lo", F.posexplode(F.array(*[_bits(hi, lo, t) for t in first])).alias("t", "key")).select("hi", "lo", "t", "key.a", "key.b"))
    sizes = keyed.groupBy("t", "a", "b").count().where("count > 1")
    fine = keyed.join(sizes.where(F.col("count") <= CROWD), ["t", "a", "b"], "left_semi").select("hi", "lo", F.col("t").alias("t"), F.lit(-1).alias("s"), "a", "b")
    crowd = keyed.join(sizes.where(F.col("count") > CROWD), ["t", "a", "b"], "left_semi")
    finer = None
    for t, bits in enumerate(first):
        rest = [p for p in range(128) if p not in set(bits)]
        keys = F.array(*[_bits(hi, lo, sorted({*bits, *more})) for more in block_tables(rest, radius, blocks)])
        finer = F.when(F.col("t") == t, keys) if finer is None else finer.when(F.col("t") == t, keys)
    refined = crowd.select("hi", "lo", "t", F.posexplode(finer).alias("s", "key")).select("hi", "lo", "t", "s", "key.a", "key.b")
    all_keys = fine.unionByName(refined)
    other = all_keys.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), "t", "s", "a", "b")
    met = all_keys.join(other, ["t", "s", "a", "b"]).where((F.col("hi") < F.col("bhi")) | ((F.col("hi") == F.col("bhi")) & (F.col("lo") < F.col("blo"))))
    return met.where(distance("", "b") <= radius).select("hi", "lo", "bhi", "blo").distinct()
