"""Longest common subsequence over many pairs at once (bit-parallel, Hyyrö 2004), in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
# longer patterns run one pair at a time on Python integers, whose words are added natively
_VECTOR_WORDS = 32
_TABLE_CELLS = 1 << 21
_PAIR_STEP = 1 << 16
#: Texts that are compared with a group of rows at once, and cells of a group's table of characters.
_DENSE_TILE, _DENSE_CELLS = 64, 1 << 23


class Texts:
    """Strings as one flat array of small character numbers."""

    def __init__(self, values: Sequence[str]):
        self.lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, codes = np.unique(flat, return_inverse=True)
        self.codes = codes.reshape(-1)
        self.alphabet = len(alphabet)

    def __len__(self) -> int:
        return len(self.lengths)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths)

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """A rectangle of character numbers; the padding number occurs in no text."""
        sizes = self.lengths[rows]
        out = np.full((len(rows), int(sizes.max(initial=0))), self.alphabet, np.int32)
        mask = np.arange(out.shape[1]) < sizes[:, None]
        out[mask] = self.codes[flat_ranges(self.starts[rows], sizes)]
        return out


def flat_ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i]+sizes[i]-1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _one_pair(pattern: np.ndarray, text: np.ndarray) -> int:
    bits: dict[int, int] = {}
    for i, ch in enumerate(pattern.tolist()):
        bits[ch] = bits.get(ch, 0) | (1 << i)
    full = (1 << len(pattern)) - 1
    v = full
    for ch in text.tolist():
        u = v & bits.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def _vector_pairs(texts: Texts, i: np.ndarray, j: np.ndarray, word_count: int) -> np.ndarray:
    rows, local = np.unique(i, return_inverse=True)
    sizes = texts.lengths[rows]
    table = np.zeros((len(rows), texts.alphabet + 1, word_count), np.uint64)
    where = flat_ranges(texts.starts[rows], sizes)
    offset = flat_ranges(np.zeros(len(rows), np.int64), sizes)
    np.bitwise_or.at(
        table,
        (np.repeat(np.arange(len(rows)), sizes), texts.codes[where], offset >> 6),
        np.left_shift(np.uint64(1), (offset & 63).astype(np.uint64)),
    )
    cols, local_j = np.unique(j, return_inverse=True)
    text = texts.padded(cols).T.copy()
    live = texts.lengths[j]
    v = np.full((word_count, len(i)), _ONES)
    flat = table.reshape(-1, word_count)
    base = local * (texts.alphabet + 1)
    count = len(i)
    for step in range(text.shape[0]):
        # pairs come ordered by falling text length, so finished ones drop off the end
        while count and live[count - 1] <= step:
            count = int(np.searchsorted(-live[:count], -step, side="left"))
        seen = flat[base[:count] + text[step][local_j[:count]]]
        if word_count == 1:
            w = v[0, :count]
            u = w & seen[:, 0]
            v[0, :count] = (w + u) | (w - u)
            continue
        carry = np.zeros(count, np.uint64)
        for k in range(word_count):
            w = v[k, :count]
            u = w & seen[:, k]
            total = w + u
            over = total < w
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[k, :count] = total | (w - u)
    left = texts.lengths[i]
    out = np.zeros(len(i), np.int64)
    for k in range(word_count):
        inside = np.clip(left - 64 * k, 0, 64)
        mask = np.where(inside == 64, _ONES, np.left_shift(np.uint64(1), (inside & 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~v[k] & mask)
    return out


def lcs_lengths(texts: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS length of texts i[n] and j[n] for every n."""
    out = np.zeros(len(i), np.int64)
    # the shorter text is the bit pattern: fewer words per step
    swap = texts.lengths[i] > texts.lengths[j]
    p, q = np.where(swap, j, i), np.where(swap, i, j)
    word_count = (texts.lengths[p] + 63) // 64
    order = np.lexsort((-texts.lengths[q], word_count))
    bounds = np.flatnonzero(np.diff(word_count[order])) + 1
    for part in np.split(order, bounds) if len(order) else []:
        n_words = int(word_count[part[0]])
        if n_words == 0:
            continue
        if n_words > _VECTOR_WORDS:
            for n in part:
                a, b = p[n], q[n]
                out[n] = _one_pair(
                    texts.codes[texts.starts[a] : texts.starts[a + 1]],
                    texts.codes[texts.starts[b] : texts.starts[b + 1]],
                )
            continue
        patterns = max(1, _TABLE_CELLS // ((texts.alphabet + 1) * n_words))
        step = max(1, _PAIR_STEP // n_words)
        if len(np.unique(p[part])) > patterns:
            step = min(step, patterns)
        for at in range(0, len(part), step):
            some = part[at : at + step]
            out[some] = _vector_pairs(texts, p[some], q[some], n_words)
    return out


class Dense:
    """LCS of some short texts with many others: all pairs of a rectangle at once.

    The others are sorted, forwards or backwards, so that what begins alike is worked out once.
    """

    def __init__(self, texts: Texts, rows: np.ndarray):
        self.texts, self.rows = texts, rows
        self.kind = np.uint32 if texts.lengths[rows].max(initial=0) <= 32 else np.uint64
        self.seen: dict[bool, np.ndarray] = {}

    @staticmethod
    def fits(texts: Texts, rows: np.ndarray) -> bool:
        return texts.lengths[rows].max(initial=0) <= 64 and (texts.alphabet + 1) * len(rows) <= _DENSE_CELLS

    def _places(self, backwards: bool) -> np.ndarray:
        """For each character, where each row has it, as bits."""
        if backwards not in self.seen:
            texts, sizes = self.texts, self.texts.lengths[self.rows]
            codes = texts.codes[flat_ranges(texts.starts[self.rows], sizes)]
            offset = flat_ranges(np.zeros(len(sizes), np.int64), sizes)
            if backwards:
                offset = np.repeat(sizes, sizes) - 1 - offset
            table = np.zeros((texts.alphabet + 1, len(sizes)), self.kind)
            bits = np.left_shift(self.kind(1), offset.astype(self.kind))
            np.bitwise_or.at(table, (codes, np.repeat(np.arange(len(sizes)), sizes)), bits)
            self.seen[backwards] = table
        return self.seen[backwards]

    def _sorted(self, cols: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters in sorted order, where a beginning of each length is new, and that order."""
        chars = self.texts.padded(cols)
        if backwards:
            # padding matches nothing, so it may come first as well
            chars = chars[:, ::-1]
        order = np.lexsort(chars.T[::-1]) if chars.shape[1] else np.arange(len(cols))
        chars = chars[order]
        new = np.ones(chars.shape, bool)
        new[1:] = np.logical_or.accumulate(chars[1:] != chars[:-1], axis=1)
        return chars, new, order

    def table(self, cols: np.ndarray) -> np.ndarray:
        """LCS lengths, a row for each of ``cols``."""
        out = np.zeros((len(cols), len(self.rows)), np.uint8)
        ways = [self._sorted(cols, backwards) for backwards in (False, True)]
        backwards = bool(ways[1][1].sum() < ways[0][1].sum())
        chars, new, order = ways[backwards]
        places = self._places(backwards)
        for at in range(0, len(cols), _DENSE_TILE):
            some, fresh = chars[at : at + _DENSE_TILE], new[at : at + _DENSE_TILE].copy()
            fresh[0] = True
            v = np.full((1, len(self.rows)), ~self.kind(0))
            node = np.zeros(len(some), np.int64)
            for step in range(some.shape[1]):
                first = np.flatnonzero(fresh[:, step])
                if len(first) > len(v):
                    v = v[node[first]]
                hit = places[some[first, step]]
                hit &= v
                total = v + hit
                v ^= hit
                v |= total
                node = np.cumsum(fresh[:, step]) - 1
            out[order[at : at + _DENSE_TILE]] = np.bitwise_count(~v)[node]
        return out


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of two text columns."""
    known = (a.notna() & b.notna()).to_numpy()
    n = int(known.sum())
    texts = Texts(a[known].tolist() + b[known].tolist())
    out = pd.Series([None] * len(a), dtype="Int64")
    out[known] = lcs_lengths(texts, np.arange(n), np.arange(n, 2 * n))
    return out


def indel_score(lcs: Column, size_a: Column, size_b: Column) -> Column:
    """100 x (1 - insertions and deletions over total length); two empty texts score 100."""
    total = size_a + size_b
    return F.when(total == 0, F.lit(100.0)).otherwise((1.0 - (total - 2 * lcs) / total) * 100.0)
