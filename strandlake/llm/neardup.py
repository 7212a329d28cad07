"""SimHash near-duplicate classes by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of segments. If two fingerprints differ in at most
``radius`` bits, some chain of consecutive segments has cumulative differences that never
exceed the proportional budgets ``length * radius / segments``. The longest chain whose
budget is zero gives the join key (two of five segments for radius 2); the longer chains
prune what shares a key, and the whole ring is the Hamming check.

Keys shared by more than ``CROWD`` fingerprints are not expanded to pairs: their
fingerprints are linked exactly through the points one bit away (two fingerprints differ in
at most two bits if and only if their one-bit balls meet), which is linear in their number.

Defined results: null text is the empty text; texts without words have fingerprint zero and
link like any other; equal texts are one class; the class id is the smallest doc_id
reachable; rows with equal doc_id are separate rows of the same document; no rows, no result.

``similar_documents`` is the counterpart for the pipeline: documents whose sets of word shingles
have a Jaccard similarity of at least ``least``, which no radius of fingerprints that can be
searched covers. The SimHash classes, of five-word fingerprints within ``RADIUS`` bits, come first: each document
is compared exactly with the first of its class. What they miss is found on the sets, leaving out
pairs that are in one class by then. Two such sets of a similarity over two thirds, not equal and both in one order,
have neighbours in common that stand side by side in both: ``D`` differences, ``n * (1 - least) /
least`` at most, part the common elements into ``D + 1`` runs, and a run of two begins after no
more than ``D`` differences and ``D`` single common elements. So the neighbours among the first
``2 * D + 2`` are the join keys (a passage in common seldom gives one). Of pairs that meet, those
whose bitmaps already differ too much are left out, and the others are verified on the whole sets
(of 64-bit hashes). Documents of a key that more than ``CROWD`` share are linked to a few hubs
first; only pairs whose ends are then still in different classes are looked at. Texts are cut into
shingles once: the sets are written, in two columns, so that the passes over the keys read the hashes of
these only, and fingerprints (of the distinct shingles here), keys and the sets of documents that meet are
made of them. Texts without words have the empty set and are alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, kept_by, release, scratch, small_side, spool, text_or_empty

RADIUS = 2
SEGMENTS = 5
#: Fingerprints of one key above which links go through one-bit balls instead of pairs.
CROWD = 32
#: Longs of a set's bitmap.
LANES = 16
#: Rounds in which the documents of a crowded key are compared with one of them. Copies share nearly all their keys and most of those
#: with nobody else, so a hub of their own is seldom further away than the second round.
HUBS = 2
#: Passes over the keys of sets, each over its share of them: what the shuffle of one holds on disk goes before the next.
PASSES = 4
#: Column of shingle hashes that were made before.
SHINGLED = "__shingles"
#: Votes of one partial sum; four 16-bit counters share a long.
CHUNK = 32_000


def votes(hashes: Column) -> list[Column]:
    """Sums of the 64 bits of a column of hashes, four 16-bit counters in each of 16 longs."""
    lane = F.lit(0x0001_0001_0001_0001)
    return [F.sum(F.shiftrightunsigned(hashes, j).bitwiseAND(lane)).alias(f"v{j}") for j in range(16)]


def counted(j: int) -> list[Column]:
    """The four counters of partial sum ``j``: of bits j, j + 16, j + 32 and j + 48."""
    return [F.sum(F.shiftrightunsigned(f"v{j}", 16 * q).bitwiseAND(F.lit(0xFFFF))).alias(f"b{j + 16 * q}") for q in range(4)]


def majority(total: Column) -> Column:
    """The long whose bit is set where more than half of the votes were."""
    out = F.lit(0).cast("long")
    for b in range(64):
        bit = (1 << b) - (1 << 64 if b == 63 else 0)
        out = out.bitwiseOR(F.when(F.col(f"b{b}") * 2 > total, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of the space-joined word shingles of lower-cased text; fewer words: one of them all; none: empty."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "")
    inner = lambda w: F.when(
        F.size(w) >= size,
        F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(size)]))),
    ).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
    # bound once, so that the split isn't repeated for each shingle
    return F.transform(F.array(words), inner)[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (long) of every row. Map-side sums leave one small row per document and 32,000 shingles to shuffle.

    Rows with a column ``SHINGLED`` bring their hashes along in it.
    """
    hashes = F.col(SHINGLED) if SHINGLED in docs.columns else shingle_hashes(text_or_empty(), shingle)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), hashes.alias("hs"))
    each = rows.select("doc_id", "row", F.posexplode_outer("hs").alias("at", "h"))
    part = each.groupBy("doc_id", "row", F.floor(F.coalesce("at", F.lit(0)) / CHUNK).alias("chunk")).agg(F.count("h").alias("n"), *votes(F.coalesce("h", F.lit(0).cast("long"))))
    whole = part.groupBy("doc_id", "row").agg(F.sum("n").alias("n"), *[c for j in range(16) for c in counted(j)])
    return whole.select("doc_id", majority(F.col("n")).alias("fp"))


def _bounds(segments: int) -> list[tuple[int, int]]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def free_chain(radius: int, segments: int) -> int:
    """Length of the longest chain whose budget is no differing bit."""
    return max(n for n in range(1, segments + 1) if n * radius < segments)


def ring_keys(radius: int, segments: int) -> Column:
    """``array<struct<start, key>>``: for every start, the segments of the chain that must agree."""
    bounds, n = _bounds(segments), free_chain(radius, segments)
    out = []
    for i in range(segments):
        key = F.lit(0).cast("long")
        for k in range(n):
            at, width = bounds[(i + k) % segments]
            key = F.shiftleft(key, width).bitwiseOR(_segment(F.col("fp"), at, width))
        out.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*out)


def ring_holds(start: Column, a: Column, b: Column, radius: int, segments: int) -> Column:
    """Every prefix of the ring from ``start`` stays within its budget; the last prefix is the Hamming check."""
    bounds, n, diff = _bounds(segments), free_chain(radius, segments), a.bitwiseXOR(b)
    by_start = F.lit(False)
    for i in range(segments):
        holds, run = F.lit(True), F.lit(0)
        for k in range(n, segments):
            run = run + F.bit_count(_segment(diff, *bounds[(i + k) % segments]))
            holds = holds & (run <= (k + 1) * radius // segments)
        by_start = by_start | ((start == i) & holds)
    return by_start


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fps(fp)`` that connect all pairs within ``radius`` (2 at most) bits."""
    if not 0 < radius <= 2:
        raise ValueError("crowded keys are linked through one-bit balls, which hold radius 1 and 2")
    keyed = spool(fps.select("fp", F.explode(ring_keys(radius, segments)).alias("k")).select("fp", "k.start", "k.key"))
    size = keyed.groupBy("start", "key").count().where("count > 1")
    few, many = size.where(F.col("count") <= CROWD).select("start", "key"), size.where(F.col("count") > CROWD).select("start", "key")
    shared = keyed.join(few, ["start", "key"], "left_semi")
    a, b = shared.select("start", "key", F.col("fp").alias("u")), shared.select("start", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["start", "key"]).where(F.col("u") < F.col("v")).where(ring_holds(F.col("start"), F.col("u"), F.col("v"), radius, segments)).select("u", "v")
    crowded = keyed.join(many, ["start", "key"], "left_semi").select("fp").distinct()
    if radius == 1:
        ball = F.array(*[F.col("fp").bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1)) for b in range(64)])
        points = crowded.select("fp", F.posexplode(ball).alias("bit", "p"))
    else:
        flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")) for b in range(64)]
        points = crowded.select("fp", F.lit(0).alias("bit"), F.explode(F.array(*flips)).alias("p"))
    # a point's ball has 65 members at most
    met = points.groupBy("bit", "p").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    starred = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.unionAll(starred).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: documents whose fingerprints link, directly or in turn, are one class."""
    rows = spool(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, radius), python=True)
    labelled = fps.join(roots, fps.fp == roots.u, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _sets(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """``doc_id, row, sid, n, low, high``: every row's distinct shingle hashes, rising, parted behind those that make keys; ``sid`` is their hash."""
    hashes = F.coalesce(F.sort_array(F.array_distinct(shingle_hashes(text_or_empty(), shingle))), F.array().cast("array<bigint>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), hashes.alias("hs"))
    rows = rows.select("doc_id", "row", F.xxhash64("hs").alias("sid"), F.size("hs").alias("n"), "hs")
    low = 2 * _most(least) + 2
    return rows.select("doc_id", "row", "sid", "n", F.slice("hs", 1, low).alias("low"), F.slice("hs", low + 1, F.col("n")).alias("high"))


def _most(least: float) -> Column:
    """Hashes that a set of ``n`` lacks of one alike at most."""
    return F.floor(F.col("n") * ((1 - least) / least) + 1e-9).cast("int")


def _whole(name: str = "hs") -> Column:
    return F.concat("low", "high").alias(name)


def _neighbours(rows: DataFrame, least: float) -> DataFrame:
    """``sid, n, key`` for every row of ``_sets``: hashes of the neighbours of its set of which sets alike share one."""
    # smaller sets are alike only if they are equal
    at = F.explode(F.sequence(F.lit(1), 2 * _most(least) + 1)).alias("at")
    each = rows.where(_most(least) > 0).select("sid", "n", "low", at)
    return each.select("sid", "n", F.xxhash64(F.get("low", F.col("at") - 1), F.get("low", F.col("at"))).alias("key"))


def _bitmaps(sets: DataFrame) -> DataFrame:
    """``sid, n, b0, b1, ...``: for each set the bits of its hashes' places, ``64 * LANES`` of them."""
    each = sets.select("sid", F.explode("hs").alias("h"))
    bit = F.expr("shiftleft(1L, cast(shiftright(h, 8) & 63 AS int))")
    lane = F.pmod(F.col("h"), F.lit(LANES))
    return each.groupBy("sid").agg(F.count("*").alias("n"), *[F.bit_or(F.when(lane == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{j}") for j in range(LANES)])


def _may_be_alike(least: float) -> Column:
    """Whether the bitmaps of two rows (columns with ``_u`` and ``_v``) allow a similarity of ``least``.

    A bit that only one of two bitmaps has stands for at least one hash that the other set lacks.
    """
    only = lambda a, b: sum((F.bit_count(F.col(f"b{j}_{a}").bitwiseAND(F.bitwise_not(f"b{j}_{b}"))) for j in range(LANES)), F.lit(0))
    shared = F.least(F.col("n_u") - only("u", "v"), F.col("n_v") - only("v", "u"))
    return shared * (1 + least) + 1e-6 >= least * (F.col("n_u") + F.col("n_v"))


def _alike(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, least: float) -> DataFrame:
    """The pairs ``u, v`` whose sets have a Jaccard similarity of ``least`` or more; most others are turned down without their sets."""
    of = lambda side: bitmaps.select(*[F.col(c).alias(f"{c}_{side}") for c in bitmaps.columns])
    near = pairs.join(of("u"), F.col("u") == F.col("sid_u")).join(of("v"), F.col("v") == F.col("sid_v"))
    near = spool(near.where(_may_be_alike(least)).select("u", "v"))
    both = near.join(sets.select(F.col("sid").alias("u"), F.col("hs").alias("hu")), "u").join(sets.select(F.col("sid").alias("v"), F.col("hs").alias("hv")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("hu", "hv")).alias("common"), (F.size("hu") + F.size("hv")).alias("sizes"))
    return both.where(F.col("common") + 1e-9 >= least * (F.col("sizes") - F.col("common"))).select("u", "v")


def similar_links(rows: DataFrame, least: float, candidates: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``u, v`` that connect all different sets of ``rows`` of similarity ``least`` or more.

    ``rows`` are ``_sets``, ``candidates`` the pairs ``u, v`` by fingerprints, both written.
    """
    spark = rows.sparkSession
    keyed = _neighbours(rows, least)
    met = None
    for i in range(PASSES):
        some = keyed.where(F.pmod("key", F.lit(PASSES)) == i)
        found = spool(some.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("times")).where("lo <> hi"))
        met = found if met is None else met.unionByName(found)
        release(spark)
    shared = spool(kept_by(keyed, met.where("times > 2").select("key"), "key").distinct())
    # twice means once each
    plain = spool(met.where("times = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v")).distinct())
    wanted = spool(shared.select("sid").unionAll(plain.select("u")).unionAll(plain.select("v")).unionAll(candidates.select("u")).unionAll(candidates.select("v")).distinct())
    # one row stands for each set
    picked = spool(kept_by(rows.select("sid", "row"), wanted, "sid").groupBy("sid").agg(F.min("row").alias("row")).select("row"))
    sets = spool(kept_by(rows.select("row", "sid", _whole()), picked, "row").select("sid", "hs"))
    bitmaps = spool(_bitmaps(sets))
    release(spark)
    links = spool(_alike(candidates, sets, bitmaps, least))
    crowded = spool(shared.join(small_side(shared.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd).select("key")), "key", "left_semi"))
    if crowded.take(1):
        # copies share many keys, and documents with a passage in common few: the former make better hubs
        shares = crowded.groupBy("sid").agg(F.count("*").alias("shares"))
        crowded = spool(crowded.drop("n").join(small_side(spool(shares)), "sid").join(small_side(bitmaps), "sid"))
        for _ in range(HUBS):
            now = spool(crowded.join(small_side(components(links, python=True)), F.col("sid") == F.col("u"), "left").withColumn("root", F.coalesce("root", "sid")).drop("u"))
            # the hub of a key: of the classes but the largest, the member with most keys
            classes = now.groupBy("key", "root").agg(F.count("*").alias("size"), F.max(F.struct("shares", "sid")).alias("best"))
            largest = small_side(spool(classes.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("top"), F.count("*").alias("classes")).where("classes > 1")))
            hub = classes.join(largest, "key").where("root <> top").groupBy("key").agg(F.max("best")["sid"].alias("hub"))
            hubs = small_side(spool(hub.join(bitmaps.withColumnRenamed("sid", "hub"), "hub").select("key", *[F.col(c).alias(f"{c}_v") for c in ("hub", *bitmaps.columns[1:])])))
            tried = now.select("key", F.col("root").alias("root_u"), *[F.col(c).alias(f"{c}_u") for c in bitmaps.columns]).join(hubs, "key").where("sid_u <> hub_v").where(_may_be_alike(least))
            tried = tried.select(F.least("sid_u", "hub_v").alias("u"), F.greatest("sid_u", "hub_v").alias("v")).distinct()
            found = spool(_alike(tried, sets, bitmaps, least))
            links = links.unionByName(found)
            # keys whose documents are one class by now have nothing more to show
            crowded = now.drop("root").join(largest.select("key"), "key", "left_semi")
            release(spark)
    roots = components(links, python=True).select(F.col("u").alias("sid"), "root")
    members = spool(shared.join(small_side(roots), "sid", "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root")))
    # bitmaps go along, so that a pair that can't be alike isn't made
    mapped = spool(members.drop("n").join(small_side(bitmaps), "sid"))
    a, b = (mapped.select("key", *[F.col(c).alias(f"{c}_{side}") for c in mapped.columns if c != "key"]) for side in "uv")
    pairs = a.join(b, "key").where("sid_u < sid_v and root_u <> root_v").where(_may_be_alike(least)).select(F.col("sid_u").alias("u"), F.col("sid_v").alias("v"))
    out = _alike(spool(pairs.unionByName(plain).distinct()), sets, bitmaps, least)
    return out.unionByName(links)


def _candidates(rows: DataFrame, shingle: int) -> DataFrame:
    """Pairs ``u, v`` of different sets: of each SimHash class every set and the first. ``rows`` are ``_sets``, written."""
    found = near_duplicates(rows.select(F.col("sid").alias("doc_id"), _whole(SHINGLED)), shingle)
    return spool(found.where("doc_id <> component_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")).distinct())


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``doc_id, component_id`` of every row: documents of Jaccard similarity ``least`` or more, directly or in turn, are one class."""
    if not 2 / 3 < least < 1:
        raise ValueError("two neighbouring hashes are shared for certain only where the similarity is over two thirds")
    with scratch(docs.sparkSession):
        rows = spool(_sets(docs, shingle, least))
        roots = components(similar_links(rows, least, _candidates(rows, shingle), crowd), python=True)
        sets = rows.groupBy("sid").agg(F.min("doc_id").alias("first"))
        labelled = sets.join(roots, sets.sid == roots.u, "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
        lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = labelled.join(lowest, "root").select("sid", "component_id")
        return spool(rows.select("doc_id", "sid").join(classes, "sid").select("doc_id", "component_id"))


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
