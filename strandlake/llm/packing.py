"""Best-fit packing of token sequences, improved by swaps.

Documents are tokenized whole in one narrow pass; only longer ones than a bin are cut. Full
pieces are bins of their own. The rest is dealt by hash to shards of bounded size, and each
shard is packed alone: best-fit decreasing first, then local search between underfull bins.
A step moves a piece into the room of another bin, exchanges one piece for one, or two for
one, always so that the fuller bin gets fuller: the sum of squared fills rises with every
step, so the search ends, and emptied bins go.

Defined results: null text is the empty text (its only id is the closing one); every
document has at least one piece; rows with equal doc_id are packed as documents of their
own; null doc_ids stay null, each a document of its own; no rows, no result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _L, _N, _S, ODD, Merges, _load, byte_alphabet
from .common import arrow_batches, id_again, id_text, spool, text_or_empty

CAPACITY = 2048
#: Pieces of a shard on average: bounds a task's memory, whatever the input's size.
SHARD = 40_000
#: Words a worker remembers (emptied when full).
CACHE_WORDS = 600_000
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class WordTokenizer(Merges):
    """The library's ids of a vocabulary with word ends that lower-cases and drops white space.

    Texts of plain Latin-1 are lower-cased and cut here (there, both are one character at a
    time); others are normalized and cut by the library. Each distinct word is merged once.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec, vocab = json.loads(source), json.loads(source)["model"]["vocab"]
        shown = {b: c for c, b in byte_alphabet().items()}
        end = spec["model"]["end_of_word_suffix"] or ""
        super().__init__(vocab, spec["model"]["merges"], np.array([vocab[shown[b]] for b in range(256)]), np.array([vocab[shown[b] + end] for b in range(256)]))
        self.whole = Tokenizer.from_str(source)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cache: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if not ODD.search(text):
            return _QUICK.findall(text.lower())
        normal = self.whole.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        words = [None if any(a in t for a in self.added) else self._words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        met: set[str] = set()
        for ws in words:
            met.update(ws or ())
        if fresh := sorted(met.difference(self.cache), key=len):
            # words of like length together: a round costs as much as all words that are in it
            for a in range(0, len(fresh), 5000):
                part = fresh[a : a + 5000]
                self.cache.update(zip(part, self.exact_many([w.encode() for w in part]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, ws in zip(texts, words, strict=True)]


_loaded: dict[int, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of all documents, each closed by id 0."""
    spark = docs.sparkSession
    arrow_batches(spark)
    source = spark.sparkContext.broadcast(_load(tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = zlib.crc32(source.value.encode())
        if key not in _loaded:
            _loaded[key] = WordTokenizer(source.value)
        for pdf in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in zip(pdf["doc_id"], _loaded[key].encode_batch(pdf["text"].tolist()), strict=True):
                data += b"\0\0\0\0"
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    doc.append(i), piece.append(k), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            out = {"doc_id": pd.Series(doc, dtype=object), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
            yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return id_again(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, schema))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the bins as lists of places in ``sizes``."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        if n and (fit := rooms >> n):
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Search:
    """Underfull bins, their pieces by size, and the steps between them."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.open = {b for b in range(len(bins)) if 0 < self.fill[b] < capacity}
        self.rooms = sorted((capacity - self.fill[b], b) for b in self.open)

    def _set(self, b: int, fill: int) -> None:
        if b in self.open:
            del self.rooms[bisect_left(self.rooms, (self.capacity - self.fill[b], b))]
            self.open.discard(b)
        self.fill[b] = fill
        if 0 < fill < self.capacity:
            insort(self.rooms, (self.capacity - fill, b))
            self.open.add(b)

    def _shift(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        """Pieces ``out`` of bin a go to bin b, pieces ``back`` of b to a."""
        for i in out:
            self.bins[a].remove(i)
        for i in back:
            self.bins[b].remove(i)
        self.bins[b] += out
        self.bins[a] += back
        gain = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self._set(a, self.fill[a] - gain)
        self._set(b, self.fill[b] + gain)

    def move(self, a: int) -> bool:
        """The largest piece of ``a`` that has room in a bin at least as full goes to the one it fills best."""
        for i in sorted(self.bins[a], key=lambda i: -self.sizes[i]):
            at = bisect_left(self.rooms, (self.sizes[i], -1))
            # the fullest bin with room, or the next one if that is the bin itself: emptier ones fill up less
            for _, b in self.rooms[at : at + 2]:
                if b != a and self.fill[b] + self.sizes[i] > self.fill[a]:
                    self._shift(a, b, [i], [])
                    return True
        return False

    def exchange(self, a: int, b: int) -> bool:
        """One piece of ``a`` for one of ``b``, or two for one, if that fills the fuller ``b`` further; the best such step."""
        room, s = self.capacity - self.fill[b], self.sizes
        mine, theirs = sorted(self.bins[a], key=lambda i: s[i]), self.bins[b]
        sizes = [s[i] for i in mine]
        best: tuple[int, list[int], list[int]] = (0, [], [])
        for y in theirs:
            at = bisect_left(sizes, s[y] + room + 1) - 1
            if at >= 0 and sizes[at] - s[y] > best[0]:
                best = (sizes[at] - s[y], [mine[at]], [y])
            lo, hi = 0, len(mine) - 1
            while lo < hi:  # the pair that comes nearest to the room from below
                gain = sizes[lo] + sizes[hi] - s[y]
                if gain > room:
                    hi -= 1
                else:
                    if gain > best[0]:
                        best = (gain, [mine[lo], mine[hi]], [y])
                    lo += 1
        for k, x in enumerate(mine):  # one of a for two of b
            if best[0] == room:
                break
            for m, y in enumerate(theirs):
                for z in theirs[m + 1 :]:
                    gain = s[x] - s[y] - s[z]
                    if best[0] < gain <= room:
                        best = (gain, [mine[k]], [y, z])
        if best[0] and self.fill[b] + best[0] > self.fill[a]:
            self._shift(a, b, best[1], best[2])
            return True
        return False

    def run(self) -> None:
        """Drains the emptiest bins into the others until no step is left or one open bin remains."""
        stuck: set[int] = set()
        while len(self.open) > 1:
            a = next((b for _, b in reversed(self.rooms) if b not in stuck), None)
            if a is None:
                break
            moved = False
            while a in self.open and self.move(a):
                moved = True
            if a in self.open:
                for _, b in list(self.rooms):
                    if b != a and self.fill[b] >= self.fill[a] and a in self.open and self.exchange(a, b):
                        moved = True
                        break
            if not moved:
                stuck.add(a)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of places in ``sizes``) by best fit and swaps; every size is within the capacity."""
    bins = best_fit(sizes, capacity)
    search = _Search(bins, sizes, capacity)
    search.run()
    return [b for b in search.bins if b]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = spool(pieces(docs, tokenizer_path, capacity))
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)))
    # rows that are alike would meet in one shard: a running number within the task parts them
    dealt = dealt.withColumn("shard", F.pmod(F.col("shard") + F.monotonically_increasing_id(), F.lit(shards)))

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].tolist()
        bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(pack(sizes, capacity)):
            at = 0
            for i in members:
                bin_of[i], offset[i] = b, at
                at += sizes[i]
        return pdf.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + bin_of, offset=offset)

    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    return id_again(dealt.groupBy("shard").applyInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
