"""Hierarchical packing into windows of several context sizes.

Every text is tokenized whole and closed by id 0. Full windows of the largest size are cut off
first. What is left of a document is routed to a tier, the smallest context size that holds it.
Tiers are packed from the longest down: a window starts with the longest piece of its tier, and
its gap is filled with the longest pieces of this and shorter tiers that fit. Where none fits,
one is cut so that the window is full; what remains of it goes to the tier of its new length. A
last window that can't be filled is cut into windows of powers of two. So no sequence is
padded, and a document is cut only where it is longer than the largest window or closes a gap.

Sequences of a tier are dealt to step groups: each has the same number of sequences (give or
take one) and up to ``STEP`` tokens, and sequences go by falling cost (squared lengths of their
pieces, as attention has it) to groups forth and back, so that groups cost alike.

Memory is bounded by ``SHARD`` tokens, which are packed together as they come from the reader: one
narrow pass without a shuffle, as full windows don't depend on how many documents meet.

Defined results: null text is the empty text (its only id is the closing one); an added token's
string in the text becomes its id; rows with equal doc_id are documents of their own; null
doc_ids stay null; ties of length go by arrival; no rows, no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import _load, encoder
from .common import arrow_batches, id_again, id_text, text_or_empty

#: Context sizes, powers of two; documents are routed to the smallest that holds them.
TIERS = (1024, 512, 256, 128)
#: Tokens that are packed together (a longer document by itself).
SHARD = 1 << 21
#: Tokens of a full step group.
STEP = 1 << 15

Piece = tuple[int, int, int]  # document, start, length


class _Pool:
    """Pieces by length, with the longest of at most some length at hand."""

    def __init__(self, top: int):
        self.by_size: list[list[Piece]] = [[] for _ in range(top + 1)]
        self.sizes = 0  # bit n is set if a piece of length n is there

    def put(self, piece: Piece) -> None:
        self.by_size[piece[2]].append(piece)
        self.sizes |= 1 << piece[2]

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most ``most``, 0 if there is none."""
        return (self.sizes & ((2 << most) - 1)).bit_length() - 1 if self.sizes & ((2 << most) - 1) else 0

    def take(self, size: int) -> Piece:
        piece = self.by_size[size].pop()
        if not self.by_size[size]:
            self.sizes ^= 1 << size
        return piece


def _powers(window: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """A window that isn't full as windows of powers of two, the longest first."""
    total, out, rest = sum(p[2] for p in window), [], list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            need, part = 1 << bit, []
            while need:
                d, start, n = rest.pop()
                if n > need:
                    rest.append((d, start + need, n - need))
                    n = need
                part.append((d, start, n))
                need -= n
            out.append((1 << bit, part))
    return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Full sequences as ``size, pieces`` of documents with these lengths (1 and more)."""
    tiers = tuple(sorted(tiers, reverse=True))
    top, pool = tiers[0], _Pool(tiers[0])
    out: list[tuple[int, list[Piece]]] = []
    for d, n in enumerate(lengths):
        full = n - n % top
        out += [(top, [(d, start, top)]) for start in range(0, full, top)]
        if n > full:
            pool.put((d, full, n - full))
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (size := pool.longest(tier)) > below:
            window = [pool.take(size)]
            gap = tier - size
            while gap:
                if size := pool.longest(gap):
                    window.append(pool.take(size))
                    gap -= size
                    continue
                if not pool.sizes:
                    break
                # a piece whose rest is a full window of its own, else the longest one
                whole = next((t for t in tiers if gap + t <= top and pool.sizes >> (gap + t) & 1), None)
                d, start, n = pool.take(gap + whole if whole else pool.longest(top))
                window.append((d, start, gap))
                pool.put((d, start + gap, n - gap))
                gap = 0
            out += [(tier, window)] if not gap else _powers(window)
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step: int = STEP) -> list[int]:
    """The step group of each sequence, numbered from 0."""
    group, used = [0] * len(sequences), 0
    for size in sorted({s for s, _ in sequences}, reverse=True):
        mine = [i for i, (s, _) in enumerate(sequences) if s == size]
        mine.sort(key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        groups = -(-len(mine) * size // step)
        for k, i in enumerate(mine):
            turn, at = divmod(k, groups)
            group[i] = used + (groups - 1 - at if turn % 2 else at)
        used += groups
    return group


def pack_tiers(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, shard: int = SHARD, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`` (and ``ids``)."""
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("context sizes must be powers of two")
    spark = docs.sparkSession
    arrow_batches(spark)
    source = spark.sparkContext.broadcast(_load(tokenizer_path))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def packed(ids_of: list[str | None], data: list[bytes], first: int, first_group: int) -> tuple[pd.DataFrame, int, int]:
        sequences = pack([len(x) // 4 for x in data], tiers)
        groups, rows = step_groups(sequences, step), []
        for s, (size, pieces) in enumerate(sequences):
            offset = 0
            for d, start, n in pieces:
                part = data[d][4 * start : 4 * (start + n)]
                rows.append((ids_of[d], start, n, zlib.crc32(part), len(data[d]) // 4, first + s, offset, size, first_group + groups[s], *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
                offset += n
        return pd.DataFrame(rows, columns=names).astype({"doc_id": object}), first + len(sequences), first_group + max(groups, default=-1) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(source.value)
        # numbers of this task's own
        sequence = group = TaskContext.get().partitionId() << 32
        ids_of: list[str | None] = []
        data: list[bytes] = []
        held = 0
        for pdf in batches:
            for i, x in zip(pdf["doc_id"], bpe.encode_batch(pdf["text"].tolist()), strict=True):
                ids_of.append(i)
                data.append(x + b"\0\0\0\0")
                held += len(x) // 4 + 1
                if held >= shard:
                    out, sequence, group = packed(ids_of, data, sequence, group)
                    yield out
                    ids_of, data, held = [], [], 0
        if data:
            yield packed(ids_of, data, sequence, group)[0]

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids array<long>" * with_ids
    return id_again(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, schema))
