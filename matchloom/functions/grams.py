"""Character n-grams inside words, for many texts at once, in NumPy for use inside tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from matchloom.functions.text import NGRAM_SIZES

#: Characters that are taken apart at once, and how many different ones fit a packed gram.
_CHUNK_CHARS, _ALPHABET = 1 << 19, 65_534
_SHIFT = np.uint64(16)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _CHUNK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(text)
    yield at, len(texts)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Rows ``text, gram number, count``, ordered by text, and the grams by number.

    Words are what single spaces part; each is padded by one space on both sides, and no gram spans two words.
    """
    padded = ["  ".join(w for w in text.split(" ") if w) for text in texts]
    padded = [f" {p} " if p else "" for p in padded]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(flat):
        return np.empty((3, 0), np.int64), []
    alphabet, codes = np.unique(flat, return_inverse=True)
    if len(alphabet) > _ALPHABET:
        return _counted(padded)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    packed = codes.reshape(-1).astype(np.uint64) + np.uint64(1)
    space = flat == 32
    # two spaces in a row part words, and texts
    apart = np.append(space[:-1] & space[1:], True)
    values, owners = [], []
    value, broken = packed.copy(), np.zeros(len(flat), bool)
    for n in range(2, max(NGRAM_SIZES) + 1):
        broken = broken[:-1] | apart[n - 2 : len(flat) - 1]
        value = value[:-1] | packed[n - 1 :] << _SHIFT * np.uint64(n - 1)
        if n in NGRAM_SIZES:
            values.append(value[~broken])
            owners.append(owner[: len(value)][~broken])
    names, which = np.unique(np.concatenate(values), return_inverse=True)
    keys = np.concatenate(owners) * len(names) + which.reshape(-1)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(first, len(keys)))
    chars = [chr(c) for c in alphabet.tolist()]
    grams = []
    for value in names.tolist():
        gram = ""
        while value:
            gram += chars[(value & 0xFFFF) - 1]
            value >>= 16
        grams.append(gram)
    return np.stack((keys[first] // len(names), keys[first] % len(names), times)), grams


def _counted(padded: list[str]) -> tuple[np.ndarray, list[str]]:
    """The same by plain counting, for more different characters than a packed gram can tell apart."""
    numbers: dict[str, int] = {}
    rows = []
    for i, text in enumerate(padded):
        counts: Counter = Counter()
        for word in text.strip(" ").split("  ") if text else []:
            word = f" {word} "
            for n in NGRAM_SIZES:
                counts.update(word[at : at + n] for at in range(len(word) - n + 1))
        rows += [(i, numbers.setdefault(gram, len(numbers)), n) for gram, n in counts.items()]
    return np.array(rows, np.int64).reshape(-1, 3).T, list(numbers)


def gram_lists(texts: list[str]) -> Iterator[tuple[int, int, pa.Array, pa.Array]]:
    """For runs of texts: the first and the end of the run, and its grams and counts as one list for each text."""
    for at, to in _chunks(texts):
        (owner, which, times), grams = gram_counts(texts[at:to])
        edges = np.searchsorted(owner, np.arange(to - at + 1))
        offsets = pa.array(edges.astype(np.int32))
        named = pa.array(grams, pa.string()).take(pa.array(which))
        yield at, to, pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
