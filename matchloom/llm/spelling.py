"""Spelling variant grouping: words one edit apart, and for each word the commoner spelling that it varies.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. One inserted, deleted or replaced letter changes the
vector of letter counts by at most two in L1: a replacement takes one letter and gives another, an insertion gives one.
So near words are found by range searches in k-d trees over these vectors, one tree for each word length.

1. Words are counted in slices and summed. Every ``_DAMAGE``-th (document, run) by checksum loses one letter before it
   is counted, as the query's contract asks; ``words`` takes that as an option.
2. Split planes come from at most some ``_SAMPLE`` distinct words, chosen by hash. They decide where words meet, not
   which: every word goes to the leaf of its length that holds it, and visits the leaves, of its own length and of the
   next, whose boxes a change of one letter can reach. Leaves are a few thousand and known to all tasks.
3. In a leaf the search goes on: boxes are split and pruned until few words are left, vectors are compared, and the
   letters are verified in order. A leaf that no plane can split further (anagrams) is cut into tiles by hash, every
   pair of tiles a group of its own, so that a task holds a bounded number of words and none is left out.
4. Each leaf sends a word's number of near words and its best one; Spark adds them up. Roots follow by doubling: after
   r rounds a word knows the form 2**r steps on. A form is at least twice as frequent, so chains are short.

Two words of a pair meet in exactly one group: in the later leaf of one length, or in the longer word's leaf.

Defined results: null texts have no words, a null id counts as empty text in the checksum; rows that repeat count as
often as they occur; words of equal frequency are told apart by code-point order; words without near words have
``n_near`` 0, no form, and themselves as root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.tables import col
from matchloom.plans.scratch import materialise, materialise_counted

MIN_LENGTH, MIN_COUNT = 5, 3
_DAMAGE = 97
_HELD = 400_000
_SAMPLE = 200_000
#: Words of a leaf, and the fewest sampled words from which a plane is taken.
_LEAF, _LEAF_SAMPLE = 2048, 8
_TILE_BYTES = 8 << 20
_PAIRS = 4096
#: One byte for each code point up to U+00FF: letters stay, A-Z are lower-cased, all other become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
_ALPHABET = [b for b in range(256) if _LETTERS[b] == b != 32]
_SLOT = np.zeros(256, np.int64)
_SLOT[_ALPHABET] = np.arange(len(_ALPHABET))
_COUNTED = "word string, n long"
_ROUTED = "cell int, tile long, role byte, word string, n long"
_NEAR = "word string, n_near long, form_n long, form string"


# --- words ------------------------------------------------------------------------------------------


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, lower-cased, one byte for each code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def checksum(run: bytes, seed: int) -> int:
    """The crc32 of ``<doc_id>:<run>`` in UTF-8; ``seed`` is that of ``<doc_id>:``."""
    return crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)


def _mapper(min_length: int, damage: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            named = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([named, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = runs(text)
                held.update(found)
                if damage:
                    seed = crc32(f"{ident}:".encode())
                    for word in set(found):
                        h = checksum(word, seed)
                        if not h % _DAMAGE:
                            at, times = h % len(word), found.count(word)
                            held[word] -= times
                            held[word[:at] + word[at + 1 :]] += times
                if len(held) >= _HELD:
                    held = Counter({w: n for w, n in held.items() if n and len(w) >= min_length})
                    yield flush()
                    held = Counter()
        held = Counter({w: n for w, n in held.items() if n and len(w) >= min_length})
        yield flush()

    return run


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: bool = False) -> DataFrame:
    """``word, n``: the distinct words of all texts that are long and frequent enough."""
    ident = F.coalesce(col(id_col).cast("string"), F.lit(""))
    texts = docs.select(ident.alias("ident"), col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    slices = texts.mapInArrow(_mapper(min_length, damage), _COUNTED)
    return slices.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- trees ------------------------------------------------------------------------------------------


def vectors(coded: list[bytes]) -> np.ndarray:
    """Letter counts, a row for each word."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    letters = _SLOT[np.frombuffer(b"".join(coded), np.uint8)]
    at = np.repeat(np.arange(len(coded)), sizes) * len(_ALPHABET) + letters
    return np.bincount(at, minlength=len(coded) * len(_ALPHABET)).reshape(len(coded), -1).astype(np.int32)


def best_plane(some: np.ndarray) -> tuple[int, int, float]:
    """Letter and count (words with at most so many on the left) that halve the rows best; share of the smaller half."""
    low = some.min(axis=0)
    share = np.stack([(some <= low + step).mean(axis=0) for step in range(3)])
    smaller = np.minimum(share, 1 - share)
    step, letter = np.unravel_index(int(smaller.argmax()), smaller.shape)
    return int(letter), int(low[letter] + step), float(smaller[step, letter])


class Tree:
    """Planes over one word length; leaves are numbered from ``first``."""

    def __init__(self, sample: np.ndarray, least: int, first: int):
        self.letter, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.first = self.next = first
        self._grow(sample, least)

    def _grow(self, sample: np.ndarray, least: int) -> int:
        node = len(self.leaf)
        for values in (self.letter, self.cut, self.left, self.right, self.leaf):
            values.append(-1)
        letter, cut, share = best_plane(sample) if len(sample) >= 2 * least else (0, 0, 0.0)
        if share * len(sample) < 1 or share < 0.02:
            self.leaf[node] = self.next
            self.next += 1
            return node
        below = sample[:, letter] <= cut
        self.letter[node], self.cut[node] = letter, cut
        self.left[node] = self._grow(sample[below], least)
        self.right[node] = self._grow(sample[~below], least)
        return node

    def reach(self, counts: np.ndarray, give: int, take: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows whose vector gets into their box by at most so many letters more and less."""
        n = len(counts)
        waiting = [(0, np.arange(n), np.full(n, give), np.full(n, take))]
        while waiting:
            node, rows, more, less = waiting.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
                continue
            over = counts[rows, self.letter[node]] - self.cut[node]
            # a count past the plane costs as many letters; a box has no other plane of this letter in between
            paid = np.maximum(over, 0)
            ok = paid <= less
            waiting.append((self.left[node], rows[ok], more[ok], (less - paid)[ok]))
            paid = np.maximum(1 - over, 0)
            ok = paid <= more
            waiting.append((self.right[node], rows[ok], (more - paid)[ok], less[ok]))


def plant(distinct: DataFrame, n: int) -> dict[int, Tree]:
    """A tree for each length of which a word was sampled."""
    ratio = max(1, -(-n // _SAMPLE))
    chosen = distinct.filter(F.pmod(F.xxhash64("word"), F.lit(ratio)) == 0).select("word")
    coded = sorted(r["word"].encode("latin-1") for r in chosen.collect())
    by_length: dict[int, list[bytes]] = {}
    for word in coded:
        by_length.setdefault(len(word), []).append(word)
    least = max(_LEAF // ratio, _LEAF_SAMPLE)
    trees, first = {}, 0
    for length, some in sorted(by_length.items()):
        trees[length] = Tree(vectors(some), least, first)
        first = trees[length].next
    return trees


# --- where words meet -------------------------------------------------------------------------------

BOTH, LEFT, RIGHT = 2, 0, 1


def _router(trees: dict[int, Tree], chunks: dict[int, tuple[int, int]] | None):
    """Rows ``cell, tile, role, word, n``; without ``chunks``, one tile for each cell.

    Words of a length that has no tree share a cell of their own, numbered below zero.
    """

    def cells(length: int, coded: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        counts = vectors(coded)
        home = np.full(len(coded), -1 - length)
        if tree := trees.get(length):
            for leaf, rows in tree.reach(counts, 0, 0):
                home[rows] = leaf
            for leaf, rows in tree.reach(counts, 1, 1):
                yield leaf, RIGHT, rows[home[rows] < leaf]
        for cell in np.unique(home):
            yield int(cell), BOTH, np.flatnonzero(home == cell)
        if tree := trees.get(length + 1):
            for leaf, rows in tree.reach(counts, 1, 0):
                yield leaf, RIGHT, rows
        else:
            yield -2 - length, RIGHT, np.arange(len(coded))

    def tiles(cell: int, role: int, rows: np.ndarray, dealt: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Home chunks meet each other and every chunk of visitors."""
        homes, visitors = (chunks or {}).get(cell, (1, 1))
        if homes == visitors == 1:
            yield 0, role, rows
            return
        if role == RIGHT:
            for h in range(homes):
                for v in range(visitors):
                    yield (h * (homes + visitors) + homes + v), RIGHT, rows[dealt[rows] % visitors == v]
            return
        for h in range(homes):
            mine = rows[dealt[rows] % homes == h]
            for other in range(homes):
                low, high = min(h, other), max(h, other)
                yield low * (homes + visitors) + high, BOTH if h == other else LEFT if h == low else RIGHT, mine
            for v in range(visitors):
                yield h * (homes + visitors) + homes + v, LEFT, mine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            coded = [w.encode("latin-1") for w in named]
            by_length: dict[int, list[int]] = {}
            for i, word in enumerate(coded):
                by_length.setdefault(len(word), []).append(i)
            for length, at in by_length.items():
                own = np.array(at)
                some = [coded[i] for i in at]
                dealt = np.fromiter((crc32(w) for w in some), np.int64, len(some))
                for cell, role, rows in cells(length, some):
                    for tile, part, chosen in tiles(cell, role, rows, dealt):
                        if not len(chosen):
                            continue
                        size = len(chosen)
                        picked = own[chosen]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(size, cell, np.int32)),
                                pa.array(np.full(size, tile, np.int64)),
                                pa.array(np.full(size, part, np.int8)),
                                batch["word"].take(pa.array(picked)),
                                pa.array(n[picked]),
                            ],
                            names=["cell", "tile", "role", "word", "n"],
                        )

    return run


# --- inside a group ---------------------------------------------------------------------------------


def _fits(home: np.ndarray, low: np.ndarray, high: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Visitors whose vector one letter more, and at most ``take`` less, can bring into the box."""
    more = np.maximum(low - home, 0).sum(axis=1)
    less = np.maximum(home - high, 0).sum(axis=1)
    return (more <= 1) & (less <= take)


def candidates(counts: np.ndarray, left: np.ndarray, right: np.ndarray, take: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) whose left vector is the right one plus a letter, less ``take[right]`` others."""
    waiting = [(left, right)]
    while waiting:
        a, b = waiting.pop()
        if not len(a) or not len(b):
            continue
        low, high = counts[a].min(axis=0), counts[a].max(axis=0)
        b = b[_fits(counts[b], low, high, take[b])]
        if not len(b):
            continue
        alike = bool((low == high).all())
        if len(a) > 1 and not alike and len(a) * len(b) > _PAIRS:
            letter, cut, _ = best_plane(counts[a])
            below = counts[a, letter] <= cut
            waiting += [(a[below], b), (a[~below], b)]
            continue
        step = max(1, (len(b) if alike else _PAIRS) // len(b))
        for at in range(0, len(a), step):
            some = a[at : at + step]
            if alike:
                apart = counts[some[0]] - counts[b]
                ok = (np.maximum(apart, 0).sum(axis=1) == 1) & (np.maximum(-apart, 0).sum(axis=1) == take[b])
                yield np.repeat(some, ok.sum()), np.tile(b[ok], len(some))
                continue
            apart = counts[some][:, None, :] - counts[b][None, :, :]
            ok = (np.maximum(apart, 0).sum(axis=2) == 1) & (np.maximum(-apart, 0).sum(axis=2) == take[b])
            i, j = np.nonzero(ok)
            yield some[i], b[j]


def one_edit(letters: np.ndarray, length: int, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of words i (all of ``length``) and j (as long where ``same``, else one shorter): is it exactly one edit?"""
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // max(length, 1))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        a, b, equal = letters[i[part]], letters[j[part]], same[part]
        replaced = (a != b).sum(axis=1) == 1
        # the shorter word is padded at its end, so a last place never matches
        head = np.cumprod(a[:, : length - 1] == b[:, : length - 1], axis=1).sum(axis=1)
        tail = np.cumprod((a[:, 1:] == b[:, : length - 1])[:, ::-1], axis=1).sum(axis=1)
        out[part] = np.where(equal, replaced, head + tail >= length - 1)
    return out


def near_pairs(coded: list[bytes], role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words: within BOTH, and of LEFT or BOTH with RIGHT. Homes have one length, visitors may be shorter."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    length = int(sizes.max())
    letters = np.array([w.ljust(length, b"\0") for w in coded], f"S{length}").view(np.uint8).reshape(-1, length)
    counts = vectors(coded)
    home, visitors, both = np.flatnonzero(role != RIGHT), np.flatnonzero(role == RIGHT), np.flatnonzero(role == BOTH)
    if not len(home) or (sizes[home] != length).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    take = (sizes == length).astype(np.int64)
    found = []
    for left, right in ((home, visitors), (both, both)):
        for i, j in candidates(counts, left, right, take):
            if right is both:
                i, j = i[i < j], j[i < j]
            if len(i):
                ok = one_edit(letters, length, i, j, take[j] == 1)
                found.append((i[ok], j[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _meet(table: pa.Table) -> pa.Table:
    """One group: for each word that has near words here, their number and the best of them."""
    named = table["word"].to_pylist()
    coded = [w.encode("latin-1") for w in named]
    n = table["n"].to_numpy()
    i, j = near_pairs(coded, table["role"].to_numpy())
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    place = np.empty(len(coded), np.int64)
    place[sorted(range(len(coded)), key=coded.__getitem__)] = np.arange(len(coded))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    times = np.diff(np.append(first, len(i)))
    text = table["word"].combine_chunks()
    return pa.table({"word": text.take(pa.array(i[first])), "n_near": times, "form_n": n[j[first]], "form": text.take(pa.array(j[first]))})


# --- tables -----------------------------------------------------------------------------------------


def _length_of(cell: int, trees: dict[int, Tree]) -> int:
    if cell < 0:
        return -1 - cell
    return next(length for length, tree in trees.items() if tree.first <= cell < tree.next)


def near_words(distinct: DataFrame, n: int, leaf: int = _LEAF) -> DataFrame:
    """``word, n_near, form_n, form`` for each group in which a word (of ``word, n``, stored) has near words."""
    trees = plant(distinct, n)
    # cells are bounded: leaves of the sampled trees, and one for each length without a tree
    sizes = distinct.mapInArrow(_router(trees, None), _ROUTED).groupBy("cell").agg(F.count_if(F.col("role") == BOTH).alias("h"), F.count_if(F.col("role") == RIGHT).alias("v"))
    chunks = {}
    for r in sizes.collect():
        most = max(1, min(2 * leaf, _TILE_BYTES // _length_of(r["cell"], trees)))
        if r["h"] > most or r["v"] > 8 * most:
            chunks[r["cell"]] = (max(1, -(-r["h"] // most)), max(1, -(-r["v"] // (4 * most))))
    routed = distinct.mapInArrow(_router(trees, chunks), _ROUTED)
    return routed.groupBy("cell", "tile").applyInArrow(_meet, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the end of their chain of forms."""
    linked, seen = materialise_counted(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "chains", n=F.count(F.lit(1)))
    moved = seen["n"]
    while moved:
        onward = linked.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = linked.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        linked, seen = materialise_counted(stepped, "chains", moved=F.count_if("moved"))
        moved, linked = seen["moved"], linked.drop("moved")
    return linked


def variants(distinct: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``word, n`` rows: a form is the commonest near word, if twice as common."""
    stored, seen = materialise_counted(distinct.select("word", "n"), "words", n=F.count(F.lit(1)))
    none = F.lit(None)
    mine = stored.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("form_n"), none.cast("string").alias("form"))
    near = near_words(stored, seen["n"]).select("word", none.cast("long").alias("n"), "n_near", "form_n", "form")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("rank"), "form")))
    summed = mine.unionAll(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    holds = -F.col("best.rank") >= 2 * F.col("n")
    forms = summed.select("word", F.when(holds, F.col("best.form")).alias("form"), "n", "n_near", F.when(holds, -F.col("best.rank")).alias("form_n"))
    forms = materialise(forms, "forms")
    out = forms.join(roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(words(docs, damage=True))
