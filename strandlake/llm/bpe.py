"""BPE encoding and decoding by speculation and verification.

A word's greedy longest-match split is the proposal. It is the BPE result exactly if no
merge could ever cross one of its token borders; that test is made for all adjacent pairs
of a batch at once with numpy, by undoing the later of the two merges at a border again and
again. Only words with a failing border are merged exactly.

Defined results: null text is the empty text (no ids); an added token's string in the text
becomes its id, as the tokenizers library does by default; texts of any length are encoded
whole; rows with equal doc_id are separate rows; null doc_ids stay null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import arrow_batches, id_again, id_text, text_or_empty

#: Words remembered by a worker; the memory is emptied when full (bounded, results unaffected).
CACHE_WORDS = 600_000

#: Bytes up to which failing words are merged together in arrays; longer ones have a heap each.
SHORT = 64

#: Letters, digits and spaces of texts that take the quick pre-tokenizer (Latin-1 without odd controls).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r "
# only contractions start with an apostrophe and letters, so words come first: they are the most
_QUICK = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Stands between words while they are matched; no token holds it.
_GAP = "\u0100"
ODD = re.compile(r"[^\t-\r -~¡-ÿ]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: char -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, spare = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(spare)] = b
            spare += 1
    return out


class Merges:
    """Exact BPE merging of many words at once. first, last: ids of each byte, and of each byte that ends a word."""

    def __init__(self, vocab: dict[str, int], merges: list, first: np.ndarray, last: np.ndarray):
        self._first_ids, self._last_ids = first, last
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self._merged_by_rank = np.zeros(max(1, len(merges)), np.int64)
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a], vocab[b]] = (r, vocab[a + b])
            self._merged_by_rank[r] = vocab[a + b]
        keys = np.array([(i << 32) | j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.iinfo(np.int64).max)

    def exact_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words at once: each round applies every word's next merge."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self._first_ids[raw]
        ids[ends - 1] = self._last_ids[raw[ends - 1]]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - size] = n, -1
        ids, none = np.append(ids, 0), np.int64(1) << 62
        spot = np.arange(n)
        key = np.full(n, none)
        first = spot[after < n]
        rank = self._pair_rank(ids[first], ids[after[first]])
        key[first] = np.where(rank < none >> 32, (rank << 32) | first, none)
        dead = np.zeros(n, bool)
        while True:
            lowest = np.minimum.reduceat(key, ends - size)
            lowest = lowest[lowest < none]
            if not len(lowest):
                break
            k = lowest & 0xFFFFFFFF
            j = after[k]
            ids[k] = self._merged_by_rank[lowest >> 32]
            dead[j], key[j] = True, none
            after[k] = after[j]
            live = k[after[k] < n]
            before[after[live]] = live
            key[k] = none
            touched = np.concatenate([live, before[k][before[k] >= 0]])
            rank = self._pair_rank(ids[touched], ids[after[touched]])
            key[touched] = np.where(rank < none >> 32, (rank << 32) | touched, none)
        left = np.cumsum(~dead)[ends - 1] * 4
        data, start, out = ids[:n][~dead].astype("<u4").tobytes(), 0, []
        for end in left.tolist():
            out.append(data[start:end])
            start = end
        return out


class _Memory(dict):
    """The ids of words; those asked for that it hasn't got are noted and count as empty."""

    def __init__(self) -> None:
        self.wanted: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.wanted.append(word)
        return b""


class SpeculativeBPE(Merges):
    """Encoder and decoder for a byte-level BPE file in the tokenizers JSON format (given as its text)."""

    def __init__(self, source: str):
        spec, alphabet = json.loads(source), byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in self.added else raw(s)
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.id_of = {self.bytes_of[i]: i for s, i in vocab.items() if s not in self.added}
        single = np.array([self.id_of[bytes([b])] for b in range(256)])
        super().__init__(vocab, spec["model"]["merges"], single, single)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        for (i, j), (r, k) in self.merge.items():
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, r
        # tokens that their own bytes do not encode to can't be proposed
        merged = np.flatnonzero(self.rank >= 0)
        sound = self._border_holds(self.left[merged], self.right[merged], self.rank[merged])
        self.unsound = set(merged[~sound].tolist())
        import ahocorasick

        self.size_of = np.array([len(b) for b in self.bytes_of])
        self._automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            if i not in self.unsound:
                self._automaton.add_word(b.decode("latin-1"), i)
        self._automaton.make_automaton()
        self._split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._library_source, self._library = source, None
        self.cache = _Memory()
        self.speculated = self.failed = 0

    def _border_holds(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: no merge ranked before ``limit`` ever joins across their border."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        top = np.iinfo(np.int64).max
        limit = np.full(len(a), top) if limit is None else limit.astype(np.int64).copy()
        holds, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossed = self._pair_rank(x, y) < limit[live]
            holds[live[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            later_left = self.rank[x] > self.rank[y]
            # of equal ranks the left one is merged first, so the right one is undone first
            limit[live] = np.where(later_left, self.rank[x], self.rank[y] + 1)
            a[live] = np.where(later_left, self.right[x], x)
            b[live] = np.where(later_left, y, self.left[y])
        return holds

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in one pass of an automaton: token ids and each one's word."""
        joined = _GAP.join(w.decode("latin-1") for w in words)
        found = np.array(list(self._automaton.iter_long(joined)), np.int64).reshape(-1, 2)
        size = np.fromiter(map(len, words), np.int64, len(words))
        gaps = np.cumsum(size + 1) - 1
        ids = found[:, 1]
        if int(self.size_of[ids].sum()) != int(size.sum()):
            raise ValueError("a byte has no token of its own")
        return ids, np.searchsorted(gaps, found[:, 0])

    def _exact(self, word: bytes) -> list[int]:
        """Exact merging of one (long) word: a heap of pairs by rank, then place."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merge[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if ids[k] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[k], ids[j] = self.merge[pair][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (p := (ids[i], ids[after[i]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], i, p))
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> None:
        """Adds the ids of ``words`` (as little-endian unsigned 32-bit) to the memory."""
        raw = [w.encode() for w in words]
        flat, owner = self._propose(raw)
        lengths = np.bincount(owner, minlength=len(words))
        bad = np.zeros(len(words), bool)
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            pairs, where = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
            holds = self._border_holds(pairs >> 32, pairs & 0xFFFFFFFF)[where]
            bad[owner[1:][inside][~holds]] = True
        self.speculated += len(words)
        self.failed += int(bad.sum())
        data, ends = flat.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
        start = 0
        for w, end in zip(words, ends, strict=True):
            self.cache[w] = data[start:end]
            start = end
        short = [i for i in np.flatnonzero(bad).tolist() if len(raw[i]) <= SHORT]
        for i, ids in zip(short, self.exact_many([raw[i] for i in short]) if short else [], strict=True):
            self.cache[words[i]] = ids
        for i in np.flatnonzero(bad).tolist():
            if len(raw[i]) > SHORT:
                self.cache[words[i]] = np.array(self._exact(raw[i]), "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        if not ODD.search(text):
            return _QUICK.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._library_source).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        split: list[list[str]] = []
        for t in texts:
            if self._split_added is not None and any(s in t for s in self.added):
                parts: list[str] = []
                for k, part in enumerate(self._split_added.split(t)):
                    parts += [part] if k % 2 else self._pieces(part)
                split.append(parts)
            else:
                split.append(self._pieces(t))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for s, i in self.added.items():
            self.cache[s] = np.array([i], "<u4").tobytes()
        get, wanted = self.cache.__getitem__, self.cache.wanted
        out, again = [], []
        for i, words in enumerate(split):
            known = len(wanted)
            out.append(b"".join(map(get, words)))
            if len(wanted) > known:
                again.append(i)
        if wanted:
            self.learn(list(dict.fromkeys(wanted)))
            wanted.clear()
            for i in again:
                out[i] = b"".join(map(get, split[i]))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, SpeculativeBPE] = {}


def encoder(source: str) -> SpeculativeBPE:
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = SpeculativeBPE(source)
    return _loaded[key]


def _load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (array of long) and ``decoded``.

    The vocabulary file is read on the driver and broadcast (its size is fixed), so executors
    need no file of their own. One narrow pass: no shuffle.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = spark.sparkContext.broadcast(_load(tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(source.value)
        for pdf in batches:
            ids = bpe.encode_batch(pdf["text"].tolist())
            decoded = [bpe.decode(x) for x in ids]
            out = {
                "doc_id": pdf["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
            }
            if with_ids:
                out |= {"ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in ids], "decoded": decoded}
            yield pd.DataFrame(out)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return id_again(docs.select(id_text(), text_or_empty().alias("text")).mapInPandas(run, schema))
