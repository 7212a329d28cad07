"""Super-mers of whole Arrow batches, with numpy: two bits a base, 31 bases a word.

The reads of a batch are laid end to end. M-mers get their codes by shifts, codes get ranks by a
formula or by looking them up in the row's own task (a vector by code, or sorted codes where
motifs are long), and the least rank of every window is found in two passes over blocks as long as
a window: running minima from each block's start and from its end, of which a window needs one
each. So the time is proportional to the bases, whatever k is, and reads aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bases of a word; its lowest 62 bits, the first base in the highest two.
WORD = 31
BASES = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 255, np.uint8)
for _letters, _code in ((b"Aa", 0), (b"Cc", 1), (b"Gg", 2), (b"TtUu", 3)):
    _CODE[list(_letters)] = _code
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of integers, as 63 bits."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * _MIX
        x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x >> np.uint64(1)).astype(np.int64)


@dataclass(frozen=True)
class Ranks:
    """How m-mers compare, by their codes: lexicographic, signature, random (XOR with ``mask``), or a table.

    A table is ``codes`` (sorted) with the rank of each, or, with no codes, a rank for every code
    (-1: not in the set).
    """

    m: int
    kind: str = "lexicographic"
    mask: int = 0
    codes: np.ndarray | None = None
    ranks: np.ndarray | None = None

    @property
    def outside(self) -> int:
        """The rank of m-mers that are not in a table's set."""
        return 1 << 32

    def of(self, code: np.ndarray) -> np.ndarray:
        if self.kind == "lexicographic":
            return code
        if self.kind == "random":
            return code ^ np.int64(self.mask)
        if self.kind == "signature":
            return code | (self._low(code).astype(np.int64) << np.int64(2 * self.m))
        assert self.ranks is not None
        if self.codes is None:
            rank = self.ranks[code]
        elif not len(self.codes):
            rank = np.full(len(code), -1, np.int64)
        else:
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.ranks[at], -1)
        return np.where(rank < 0, self.outside, rank)

    def _low(self, code: np.ndarray) -> np.ndarray:
        """The first AA is past the start, or the motif starts with AAA or ACA."""
        m, base = self.m, lambda j: (code >> np.int64(2 * (self.m - 1 - j))) & 3
        late = np.zeros(len(code), bool)
        for j in range(1, m - 1):
            late |= (base(j) == 0) & (base(j + 1) == 0)
        head = np.zeros(len(code), bool)
        if m >= 2:
            late &= ~((base(0) == 0) & (base(1) == 0))
        if m >= 3:
            head = (base(0) == 0) & (base(2) == 0) & ((base(1) == 0) | (base(1) == 1))
        return late | head


def slices(batch: pa.RecordBatch, column: int = 0, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many bases at most (a longer sequence by itself)."""
    size = np.asarray(pa.compute.binary_length(batch.column(column)))
    part = np.cumsum(size) // most
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(size) else []
    for a, b in zip(edges, [*edges[1:], len(size)], strict=True):
        yield batch.slice(a, b - a)


def bases_of(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all sequences (none null) end to end, and each one's length."""
    raw = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    code = _CODE[letters]
    if (code > 3).any():
        raise ValueError("sequences must be cut at invalid bases first")
    return code, np.diff(offsets)


def mmers(code: np.ndarray, m: int) -> np.ndarray:
    """The code of the m-mer at each place, also across the ends of sequences."""
    n = max(0, len(code) - m + 1)
    out = np.zeros(n, np.int64)
    for j in range(m):
        out <<= 2
        out |= code[j : j + n]
    return out


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, in two passes over blocks of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.int64).max)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_places(rank: np.ndarray, width: int) -> np.ndarray:
    """The place of the least rank in every window, the leftmost of equals."""
    bits = max(1, len(rank).bit_length())
    if len(rank) and int(rank.max()) >> (63 - bits):
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64).ravel()
    return window_least((rank << np.int64(bits)) | np.arange(len(rank)), width) & ((1 << bits) - 1)


@dataclass
class Cut:
    """Super-mers of a batch. ``kmer`` is the number of a super-mer's first k-mer among all k-mers of the batch, ``n`` how many it has."""

    read: np.ndarray
    place: np.ndarray  # of the first base, end to end
    motif: np.ndarray  # place of the minimizer, end to end
    kmer: np.ndarray
    n: np.ndarray
    minimizer: np.ndarray  # code
    digit: np.ndarray
    outside: np.ndarray  # whether the minimizer isn't in the set


def cut(code: np.ndarray, length: np.ndarray, k: int, ranks: Ranks, hot: np.ndarray | None = None, digits: int = 1) -> Cut:
    """Maximal runs of k-mers with one minimizer occurrence.

    K-mers of the minimizers ``hot`` (codes) are parted further, by their least m-mer under a
    second, hashed order; ``digit`` is made of that, so it depends on the k-mer alone as well.
    """
    m, width = ranks.m, k - ranks.m + 1
    mm = mmers(code, m)
    rank = ranks.of(mm)
    place = window_places(rank, width)
    count = np.maximum(length - k + 1, 0)
    total = int(count.sum())
    read = np.repeat(np.arange(len(length)), count)
    starts = np.cumsum(length) - length
    heads = np.cumsum(count) - count
    at = np.arange(total) - heads[read] + starts[read]
    least = place[at] if total else np.zeros(0, np.int64)
    fresh = np.ones(total, bool)
    fresh[1:] = (read[1:] != read[:-1]) | (least[1:] != least[:-1])
    second = None
    if hot is not None and len(hot) and total:
        is_hot = np.isin(mm[least], hot)
        if is_hot.any():
            second = window_places(mixed(mm) >> np.int64(24), width)[at]
            fresh[1:] |= is_hot[1:] & (second[1:] != second[:-1])
    first = np.flatnonzero(fresh)
    motif = least[first]
    digit = np.zeros(len(first), np.int32)
    if second is not None:
        digit = np.where(is_hot[first], 1 + mixed(mm[second[first]]) % digits, 0).astype(np.int32)
    outside = rank[motif] >= ranks.outside if ranks.kind == "table" else np.zeros(len(first), bool)
    return Cut(read[first], at[first], motif, first, np.diff(np.append(first, total)), mm[motif], digit, outside)


def words_of(code: np.ndarray, start: np.ndarray, size: np.ndarray, width: int | None = None) -> np.ndarray:
    """Packed words, a row for each stretch of ``size`` bases from ``start``; what is missing to a full word is 0."""
    width = width or max(1, int(-(-size.max(initial=1) // WORD)))
    out = np.zeros((len(start), width), np.int64)
    padded = np.append(code, np.zeros(width * WORD, np.uint8))
    for w in range(width):
        for j in range(w * WORD, (w + 1) * WORD):
            out[:, w] <<= 2
            out[:, w] |= np.where(j < size, padded[start + np.minimum(j, size)], 0)
    return out


def bases_of_words(words: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes end to end of sequences whose words (all of the first one, all of the second, ...) belong to ``owner``."""
    shifts = np.arange(2 * (WORD - 1), -1, -2)
    every = ((words[:, None] >> shifts) & 3).astype(np.uint8)
    n = np.bincount(owner, minlength=len(size))
    nth = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    keep = nth[:, None] * WORD + np.arange(WORD) < size[owner][:, None]
    return every[keep]


def strings(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of bases as strings."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(BASES[code[at]].tobytes())).cast(pa.string())


def word_lists(words: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of ``words_of`` as lists of as many words as each one's bases need."""
    need = -(-size // WORD)
    offsets = np.concatenate([[0], np.cumsum(need)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[np.arange(words.shape[1]) < need[:, None]]))


def combined(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one with the sum of their weights (rows with equal hashes may stay apart)."""
    if not len(rows):
        return rows, weight
    key = np.zeros(len(rows), np.int64)
    for c in range(rows.shape[1]):
        key = mixed(key ^ rows[:, c])
    order = np.argsort(key, kind="stable")
    rows, weight = rows[order], weight[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.add.reduceat(weight, first)


def packed_batches(batches: Iterator[pa.RecordBatch], k: int, ranks: Ranks, hot: np.ndarray | None, digits: int, hold: int, strict: bool) -> Iterator[pa.RecordBatch]:
    """``minimizer, digit, size, words, weight`` from batches of sequences: equal super-mers are summed up among ``hold`` of them."""
    width = -(-(2 * k - ranks.m) // WORD)
    rows: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        every, n = combined(np.concatenate(rows), np.concatenate(weights))
        size = every[:, 2]
        names = ["minimizer", "digit", "size", "words", "weight"]
        return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1].astype(np.int32)), pa.array(size.astype(np.int32)), word_lists(every[:, 3:], size), pa.array(n)], names)

    for batch in (part for b in batches for part in slices(b)):
        code, length = bases_of(batch.column(0))
        s = cut(code, length, k, ranks, hot, digits)
        keep = checked(s.outside, strict)
        size = s.n + k - 1
        words = words_of(code, s.place[keep], size[keep], width)
        rows.append(np.column_stack([s.minimizer[keep], s.digit[keep], size[keep], words]))
        weights.append(np.ones(len(words), np.int64))
        held += len(words)
        if held >= hold:
            # what is left after summing up may still be summed up with what follows
            every, n = combined(np.concatenate(rows), np.concatenate(weights))
            rows, weights, held = [every], [n], len(every)
            if held >= hold // 2:
                yield out()
                rows, weights, held = [], [], 0
    if held:
        yield out()


def checked(outside: np.ndarray, strict: bool) -> np.ndarray:
    """Which super-mers stay: those with a minimizer of the set; strict: others are an error."""
    if strict and outside.any():
        raise ValueError("a k-mer has no minimizer of the given set")
    return ~outside
