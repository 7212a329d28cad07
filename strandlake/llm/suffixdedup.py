"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if it lies in a ``threshold``-byte string that also starts anywhere else. Suffixes
are ordered only through ``threshold`` bytes, by passes over most significant digits; after
the last pass, suffixes that are still in one group are exactly the repeated strings.

The first digit is content-defined, which is what lets the sort be dealt out: every string of
``threshold`` bytes has one anchor, the last of its least-hashed ``GRAM``-byte pieces, and equal
strings have equal anchors at equal places. So only suffixes with the same anchor hash and
the same place in it need comparing. A run is all suffixes of a text that share an anchor:
runs whose anchor no other run has are done; runs with the same content are repeated as a
whole; of what is left, one copy of each distinct run is sorted by the following digits, eight
bytes at a time, and single suffixes leave after each pass.

Equal texts are treated as one text that is repeated. Texts are cut by no length; matches
never cross texts.

Defined results: null text is the empty text; a text of fewer bytes than the threshold loses
nothing; every copy of a repeated string goes; rows with equal doc_id are separate rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, spool, text_or_empty

THRESHOLD = 400
#: Bytes of an anchor: shorter ones meet by chance more often, longer ones come closer together.
GRAM = 100
#: Distinct runs of one anchor that are sorted in one group; more are dealt on by further digits.
CROWD = 2000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Polynomial hashes of any pieces of a text, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = _powers(n + 1, _INVERSE)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _ODD), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def runs(text: bytes, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of a text: anchor hash, anchor place, first and last suffix, content hash."""
    n = len(text)
    if n < threshold:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    hashed = Hasher(np.frombuffer(text, np.uint8))
    start = np.arange(n - gram + 1)
    grams = hashed(start, start + gram)
    anchor = last_minimum(_mixed(grams), threshold - gram + 1)
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    first, last = edge, np.r_[edge[1:], len(anchor)] - 1
    at = anchor[edge]
    content = _mixed(hashed(first, last + threshold)) ^ ((at - first).astype(np.uint64) << np.uint64(40)) ^ ((last - first).astype(np.uint64) << np.uint64(20))
    return grams[at].view(np.int64), at, first, last, content.view(np.int64)


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of the last smallest one, by their top 40 bits."""
    if len(values) >= 1 << 24:  # places need more bits than are free: in overlapping parts
        step, out = (1 << 23), []
        for a in range(0, len(values) - width + 1, step):
            out.append(a + last_minimum(values[a : a + step + width - 1], width))
        return np.concatenate(out)
    n = len(values)
    low = np.uint64((1 << 24) - 1)  # the place in the low bits, reversed, makes the last of equal values the smallest
    keys = (values & ~low) | (np.uint64(n - 1) - np.arange(n, dtype=np.uint64))
    pad = -n % width
    full = np.r_[keys, np.full(pad, np.iinfo(np.uint64).max)].reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    lowest = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (np.uint64(n - 1) - (lowest & low)).astype(np.int64)


def repeated_suffixes(blocks: list[bytes], anchor: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes over aligned runs: block and place of every suffix that another block has too.

    blocks[i] holds the bytes from its first suffix on; its suffixes have the places
    first[i]..last[i], counted from the anchor. Suffixes are grouped by anchor and place to
    begin with; a pass regroups those still together by their next eight bytes, and singles leave.
    """
    size = last - first + 1
    owner = np.repeat(np.arange(len(blocks)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    flat = np.frombuffer(b"".join(blocks) + b"\0" * 8, np.uint8)
    begin = np.cumsum([0, *map(len, blocks)])[:-1]
    at = begin[owner] + place - first[owner]
    digits = np.lib.stride_tricks.sliding_window_view(flat, 8)
    group, digit, depth = np.unique(anchor, return_inverse=True)[1][owner], place, 0
    while True:
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        named = np.empty(len(order), np.int64)
        named[order] = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(order)]) - 1
        stay = np.bincount(named)[named] > 1 if len(named) else np.zeros(0, bool)
        group, owner, place, at = named[stay], owner[stay], place[stay], at[stay]
        if depth >= threshold or not len(at):
            return owner, place
        wide = min(8, threshold - depth)
        digit = np.ascontiguousarray(digits[at + depth]).view(np.uint64).ravel()
        if wide < 8:
            digit = digit & np.uint64((1 << 8 * wide) - 1)
        depth += wide


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    return start[edge], end[np.r_[edge[1:], len(start)] - 1] if len(edge) else end


def removed(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what is left, for the byte ranges ``start``..``end``."""
    a, b = _merged(start, end)
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return int((b - a).sum()), len(a), b"".join(kept)


def _intervals(owner: np.ndarray, start: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and end of the bytes that suffixes of rising ``start`` cover, those that touch joined."""
    new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + threshold)][: len(owner)]
    edge = np.flatnonzero(new)
    return owner[edge], start[edge], start[np.r_[edge[1:], len(start)][: len(edge)] - 1] + threshold


def dedup_documents(docs: DataFrame, threshold: int = THRESHOLD, gram: int | None = None, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, what is left, binary) of every row."""
    gram = gram or max(1, threshold // 4)
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_or_empty().alias("text"))
    data = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), F.encode("text", "UTF-8").alias("data"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = list(zip(*[runs(d, threshold, gram) for d in pdf["data"]], strict=True)) or [[]] * 5
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "blob": pdf["blob"], "n_bytes": pdf["data"].map(len), **dict(zip(("anchor", "at", "first", "last", "content"), parts, strict=True))})

    arrays = "anchor array<long>, at array<int>, first array<int>, last array<int>, content array<long>"
    texts = spool(data.mapInPandas(cut, f"doc_id long, blob binary, n_bytes long, {arrays}"))

    # one row stands for equal texts
    classes = texts.groupBy("blob").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))
    long = texts.where(F.col("n_bytes") >= threshold).join(classes, "blob").where("doc_id = rep")
    zipped = F.arrays_zip("anchor", "content", "at", "first", "last")
    each = spool(long.dropDuplicates(["blob"]).select("blob", "doc_id", "copies", F.explode(zipped).alias("r")).select("blob", "doc_id", "copies", "r.*"))

    # the first digit: runs of one content are summed up before they are dealt by anchor, and of
    # the anchors those stay that occur again
    contents = each.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("blob", "at")).alias("one"))
    kinds = contents.groupBy(F.col("anchor").alias("again")).agg(F.count("*").alias("kinds"), F.sum("n").alias("runs")).where("runs > 1")
    distinct = spool(contents.join(kinds, F.col("anchor") == F.col("again")).drop("again", "runs"))
    known = distinct.where("n > 1").select("anchor", "content")
    whole = each.where("copies = 1").join(known, ["anchor", "content"]).select("blob", F.col("first").alias("a"), (F.col("last") + threshold).alias("b"))

    # one copy of each distinct run of anchors with several goes on to the byte digits
    mixed = distinct.where("kinds > 1").select("anchor", "content", "n", "one.blob", "one.at", (F.col("kinds") > crowd).alias("crowded"))
    asked = each.join(mixed.select("blob", "at", "n", "crowded"), ["blob", "at"]).select(
        "blob", "doc_id", F.struct("anchor", "at", "first", "last", ((F.col("n") == 1) & (F.col("copies") == 1)).alias("open"), "crowded").alias("r")
    )
    asked = asked.groupBy("blob", "doc_id").agg(F.collect_list("r").alias("rs"))
    carried = data.join(asked, ["blob", "doc_id"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["blob", "anchor", "at", "first", "last", "open", "crowded", "block"]
        for pdf in batches:
            out = [
                (blob, r["anchor"], r["at"], r["first"] - r["at"], r["last"] - r["at"], r["open"], r["crowded"], text[r["first"] : r["last"] + threshold])
                for blob, text, rs in zip(pdf["blob"], pdf["data"], pdf["rs"], strict=True)
                for r in rs
            ]
            yield pd.DataFrame(out, columns=names)

    blocks = carried.select("blob", "data", "rs").mapInPandas(extract, "blob binary, anchor long, at int, first int, last int, open boolean, crowded boolean, block binary")
    blocks = spool(blocks.dropDuplicates(["blob", "at"]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            owner, place = repeated_suffixes(pdf["block"].tolist(), pdf["anchor"].to_numpy(), pdf["first"].to_numpy(np.int64), pdf["last"].to_numpy(np.int64), threshold)
            mine = pdf["open"].to_numpy(bool)[owner]
            owner, place = owner[mine], place[mine]
            order = np.lexsort((place, owner))
            o, a, b = _intervals(owner[order], place[order] + pdf["at"].to_numpy(np.int64)[owner[order]], threshold)
            return pd.DataFrame({"blob": pdf["blob"].to_numpy()[o], "a": a, "b": b})

        held: list[pd.DataFrame] = []
        for pdf in batches:  # sorted by anchor: all but the last anchor's rows are complete
            held.append(pdf)
            if sum(map(len, held)) < 4000:
                continue
            every = pd.concat(held, ignore_index=True)
            over = every["anchor"] == every["anchor"].iloc[-1]
            held = [every[over]]
            if not over.all():
                yield done(every[~over].reset_index(drop=True))
        if held:
            yield done(pd.concat(held, ignore_index=True))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.where("not crowded").repartition(n, "anchor").sortWithinPartitions("anchor").mapInPandas(compare, "blob binary, a int, b int")

    # anchors with very many distinct runs: every suffix is dealt by its place and all its bytes
    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                k = r.last - r.first + 1
                keys = [hashlib.md5(r.block[i : i + threshold]).digest() for i in range(k)]
                yield pd.DataFrame({"blob": [r.blob] * k, "anchor": r.anchor, "place": np.arange(r.first, r.last + 1), "at": r.at, "open": r.open, "digit": keys})

    wide = blocks.where("crowded").mapInPandas(widest, "blob binary, anchor long, place int, at int, open boolean, digit binary")
    twice = wide.groupBy("anchor", "place", "digit").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found_wide = wide.where("open").join(twice, ["anchor", "place", "digit"]).select("blob", (F.col("at") + F.col("place")).alias("a"), (F.col("at") + F.col("place") + threshold).alias("b"))

    spans = spool(whole.unionByName(found).unionByName(found_wide).groupBy("blob").agg(F.collect_list(F.struct("a", "b")).alias("spans")))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, blob, text, ss in zip(pdf["doc_id"], pdf["blob"], pdf["data"], pdf["spans"], strict=True):
                ends = np.array([(s["a"], s["b"]) for s in ss], np.int64).reshape(-1, 2)
                gone, count, kept = removed(text, ends[:, 0], ends[:, 1])
                out.append((blob, gone, count, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            yield pd.DataFrame(out, columns=["found", "n_removed", "n_spans", "sha", *(["kept"] if with_text else [])])

    # only texts that lose a part are read again
    partly = data.join(spans, "blob").mapInPandas(remove, "found binary, n_removed long, n_spans long, sha string" + ", kept binary" * with_text)
    known_rows = texts.select("doc_id", "blob", "n_bytes")
    several = classes.where("copies > 1").select(F.col("blob").alias("several"))
    joined = known_rows.join(several, F.col("blob") == F.col("several"), "left").join(partly.dropDuplicates(["found"]), F.col("blob") == F.col("found"), "left")
    gone = F.col("several").isNotNull() & (F.col("n_bytes") >= threshold)
    zero = F.lit(0).cast("long")
    out = joined.select(
        F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("blob")))).alias("kept_sha256"),
        *(["blob", F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    if not with_text:
        return out
    whole_texts = data.select(F.col("blob").alias("b"), "data").dropDuplicates(["b"])
    return out.join(whole_texts, F.col("blob") == F.col("b")).withColumn("kept", F.coalesce("kept", "data")).drop("blob", "b", "data")
