"""Token-sort similarity: the score of a pair, and exact joins on it."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.lcs import Dense, Texts, flat_ranges, indel_score, lcs_length, lcs_lengths
from matchloom.functions.text import token_sort_form
from matchloom.operators import blocks, deletions, metric
from matchloom.operators.blocks import Best, Groups, Shape, Weights
from matchloom.operators.metric import Space
from matchloom.plans.scratch import materialise

_RECT_LEFT, _RECT_RIGHT = 1024, 2048
#: The first partners of a row are few, so that what they reach rules out others before those are listed.
_RECT_FIRST = 128
#: Share of pairs that shared characters leave, above which the LCS of all pairs is worked out.
_MANY = 0.03
_SMALL_MEETING = 4096
_PAIR_BATCH = 1 << 19
_PAIR_ROUND, _PAIR_STEP = 1 << 17, 1 << 13
#: Above this share of pairs worth a look, a rectangle goes through the matrix product as a whole.
_DENSE = 0.1
_COUNT_CELLS = 1 << 25


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts regardless of word order, 0..100."""
    fa, fb = token_sort_form(a), token_sort_form(b)
    return indel_score(lcs_length(fa, fb), F.length(fa), F.length(fb))


class _Bags:
    """Each text as a set of (character, occurrence): shared elements bound the LCS from above."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.counts: np.ndarray | None = None
        owner = texts.owners()
        order = np.lexsort((texts.codes, owner))
        group = owner[order] * (texts.alphabet + 1) + texts.codes[order]
        first = np.concatenate(([True], np.diff(group) != 0)) if len(group) else np.empty(0, bool)
        run = np.flatnonzero(first)
        nth = np.arange(len(group)) - np.repeat(run, np.diff(np.concatenate((run, [len(group)]))))
        element = np.empty(len(group), np.int64)
        element[order] = texts.codes[order] * (int(texts.lengths.max(initial=0)) + 1) + nth
        names, self.elements = np.unique(element, return_inverse=True)
        self.elements = self.elements.reshape(-1)
        self.width = len(names)

    def matrix(self, rows: np.ndarray, used: np.ndarray) -> np.ndarray:
        """0/1 rows over the elements flagged in ``used``."""
        slot = np.cumsum(used) - 1
        sizes = self.texts.lengths[rows]
        element = self.elements[flat_ranges(self.texts.starts[rows], sizes)]
        owner = np.repeat(np.arange(len(rows)), sizes)
        seen = used[element]
        out = np.zeros((len(rows), int(used.sum())), np.float32)
        out[owner[seen], slot[element[seen]]] = 1.0
        return out

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Characters that single pairs share, or a bound of them if the table of counts would be too large."""
        texts = self.texts
        if self.counts is None and len(texts) * texts.alphabet <= _COUNT_CELLS and texts.lengths.max(initial=0) < 1 << 15:
            at = texts.owners() * texts.alphabet + texts.codes
            self.counts = np.bincount(at, minlength=len(texts) * texts.alphabet).astype(np.int16).reshape(len(texts), -1)
        if self.counts is None:
            return np.minimum(texts.lengths[i], texts.lengths[j])
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), _PAIR_ROUND):
            part = slice(at, at + _PAIR_ROUND)
            out[part] = np.minimum(self.counts[i[part]], self.counts[j[part]]).sum(axis=1)
        return out

    def present(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, bool)
        out[self.elements[flat_ranges(self.texts.starts[rows], self.texts.lengths[rows])]] = True
        return out


class _Rows:
    """Some left rows of a meeting, and two ways to compare them with right ones.

    Shared characters bound the LCS. If they rule out too few of the pairs, the LCS of all is cheaper.
    """

    def __init__(self, texts: Texts, rows: np.ndarray, best: Best):
        self.texts, self.rows, self.best = texts, rows, best
        self.dense: Dense | None = None
        self.bag: np.ndarray | None = None

    def shared(self, bags: _Bags, used: np.ndarray, cols: np.ndarray, once: np.ndarray | None, u: np.ndarray, v: np.ndarray):
        """Pairs that share at least ``u + v * length`` characters, and how many."""
        if self.bag is None:
            self.bag = bags.matrix(self.rows, used)
        sizes = self.texts.lengths[cols].astype(np.float32)
        # what is shared beyond the least, as one product
        wide = np.column_stack((self.bag, -u.astype(np.float32), -v.astype(np.float32)))
        more = wide @ np.column_stack((bags.matrix(cols, used), np.ones(len(cols), np.float32), sizes)).T
        near = more >= 0
        if once is not None:
            near &= once
        at = np.flatnonzero(near)
        if len(at) > _MANY * near.size and self.best.shape.two_sided and Dense.fits(self.texts, self.rows):
            self.dense = Dense(self.texts, self.rows)
        r, c = np.divmod(at, len(cols))
        return r, c, np.rint(more.ravel()[at] + u[r] + v[r] * sizes[c]).astype(np.int64)

    def common(self, cols: np.ndarray, once: np.ndarray | None, u: np.ndarray, v: np.ndarray):
        """Pairs whose LCS has at least ``u + v * length`` characters, and their LCS."""
        lcs = self.dense.table(cols)
        sizes, which = np.unique(self.texts.lengths[cols], return_inverse=True)
        asked = np.clip(np.ceil(u[None, :] + v[None, :] * sizes[:, None]), 0, 255).astype(np.uint8)
        near = lcs >= asked[which.reshape(-1)]
        if once is not None:
            near &= once.T
        at = np.flatnonzero(near)
        c, r = np.divmod(at, len(self.rows))
        return r, c, lcs.ravel()[at].astype(np.int64)


def fuzzy_scorer(cutoff: float):
    """Length bound, then character bound as a matrix product, then LCS on what is left."""

    def need(total):
        # least LCS with 200 * LCS >= cutoff * total
        return np.ceil(cutoff * total / 200 - 1e-9).astype(np.int64) if cutoff % 1 else -((-int(cutoff) * total) // 200)

    def ratio(total: np.ndarray, lcs: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / total) * 100.0)

    def finish(texts: Texts, i: np.ndarray, j: np.ndarray):
        total = texts.lengths[i] + texts.lengths[j]
        lcs = lcs_lengths(texts, i, j)
        hit = lcs >= need(total)
        i, j, total, lcs = i[hit], j[hit], total[hit], lcs[hit]
        return i, j, ratio(total, lcs)

    def small(texts: Texts, best: Best, groups: Groups, waiting: list):
        if waiting:
            i, j = (np.concatenate(c) for c in zip(*waiting))
            short = np.minimum(texts.lengths[i], texts.lengths[j])
            near = short >= need(texts.lengths[i] + texts.lengths[j])
            groups.scored += int(near.sum())
            best.add(*finish(texts, i[near], j[near]))

    def least(texts: Texts, best: Best, rows: np.ndarray, cols: np.ndarray):
        """``u, v`` for each row: a partner of length n must share ``u + v * n`` characters to be kept at all."""
        slots, pos = best.slot[rows], best.pos
        floor = best.floor[slots]
        if not best.shape.two_sided and pos[rows].max() >= pos[cols].min():
            # either may be the item of a pair
            asked, later = np.minimum(floor, best.floor[best.slot[cols]].min()), np.zeros(len(rows), bool)
        else:
            worst = best.worst[slots]
            asked, later = floor, worst > pos[cols].max() if best.shape.high_b else worst < pos[cols].min()
        # two scores of totals up to ``most`` are equal or 1 / most of a character apart; ties lose to earlier partners
        most = 2 * int(texts.lengths.max(initial=0))
        slack = 1e-3 + 1e-6 * most
        shift = np.where(later & (asked >= cutoff), 0.5 / max(most, 1) if most <= 400 else -slack, -slack)
        v = np.maximum(asked, cutoff) / 200
        return texts.lengths[rows] * v + shift, v

    def large(texts: Texts, best: Best, groups: Groups, i: np.ndarray, j: np.ndarray, overlap: np.ndarray):
        """Most promising pairs first, then early partners; what they yield rules out others before their LCS."""
        total = texts.lengths[i] + texts.lengths[j]
        bound = np.where(total == 0, 100.0, (1.0 - (total - 2 * overlap) / np.maximum(total, 1)) * 100.0)
        order = np.lexsort((np.maximum(best.pos[i], best.pos[j]), (-bound * 10).astype(np.int16)))
        step = min(_PAIR_ROUND, max(_PAIR_STEP, len(order) // 8))
        while len(order):
            order = order[best.able(i[order], j[order], bound[order])]
            some, order = order[:step], order[step:]
            groups.scored += len(some)
            best.add(*finish(texts, i[some], j[some]))
            if len(order):
                best.compact()

    def score(table: pa.Table, groups: Groups, best: Best):
        texts = Texts(table["form"].to_pylist())
        bags = _Bags(texts)
        waiting, size = [], 0
        for left, right in groups:
            if groups.ok is not None and groups.ok.mean() < _DENSE:
                r, c = np.nonzero(groups.ok)
                i, j = left[r], right[c]
                overlap = bags.shared(i, j)
                near = overlap >= need(texts.lengths[i] + texts.lengths[j])
                large(texts, best, groups, i[near], j[near], overlap[near])
                continue
            rank = groups.precedence(left, right, texts.lengths)
            if len(left) * len(right) <= _SMALL_MEETING:
                i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                if rank is not None:
                    once = rank[i] < rank[j]
                    i, j = i[once], j[once]
                waiting.append((i, j))
                size += len(i)
                if size >= _PAIR_BATCH:
                    small(texts, best, groups, waiting)
                    waiting, size = [], 0
                continue
            used = bags.present(left) & bags.present(right)
            if groups.shape.two_sided:
                # in the order of ties: later partners with a score that is already reached are ruled out
                right = right[np.argsort(-best.pos[right] if groups.shape.high_b else best.pos[right], kind="stable")]
            state = None
            for rows, cols, once in blocks.sub_blocks(left, right, rank, _RECT_LEFT, _RECT_RIGHT, _RECT_FIRST):
                if state is None or state.rows is not rows:
                    if state is not None:
                        best.absorb(state.best)
                    state = _Rows(texts, rows, best.part() if groups.shape.two_sided else best)
                u, v = least(texts, state.best, rows, cols)
                if state.dense is not None:
                    r, c, lcs = state.common(cols, once, u, v)
                    i, j = rows[r], cols[c]
                    total = texts.lengths[i] + texts.lengths[j]
                    groups.scored += len(rows) * len(cols)
                    hit = lcs >= need(total)
                    state.best.add(i[hit], j[hit], ratio(total[hit], lcs[hit]))
                else:
                    r, c, overlap = state.shared(bags, used, cols, once, u, v)
                    i, j = rows[r], cols[c]
                    enough = overlap >= need(texts.lengths[i] + texts.lengths[j])
                    large(texts, state.best, groups, i[enough], j[enough], overlap[enough])
                if state.best is not best:
                    state.best.compact()
            if state is not None:
                best.absorb(state.best)
        small(texts, best, groups, waiting)

    return score


# --- signatures -----------------------------------------------------------------------------------
# If a pair reaches cutoff c, and b is the longer text (length n), at most D = n(200-2c)/100 characters
# are inserted or deleted between the two. Cut b into D+1 pieces: one stays whole inside a. So b emits
# D+1 disjoint pieces, a emits every substring of the piece sizes its possible partners use.


def _piece_count(n: Column, cutoff: int) -> Column:
    return F.floor(n * (200 - 2 * cutoff) / 100).cast("int") + 1


def _piece_size(n: Column, cutoff: int) -> Column:
    return F.floor(n / _piece_count(n, cutoff)).cast("int")


def _pieces(form: Column, cutoff: int) -> Column:
    n = F.length(form)
    size = _piece_size(n, cutoff)
    starts = F.sequence(F.lit(0), _piece_count(n, cutoff) - 1)
    return F.array_distinct(F.transform(starts, lambda s: F.substr(form, (s * size + 1).cast("int"), size)))


def _windows(form: Column, cutoff: int) -> Column:
    n = F.length(form)
    longest = F.floor(n * (200 - cutoff) / cutoff).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(n, longest), lambda m: _piece_size(m, cutoff)))
    fitting = F.filter(sizes, lambda q: (q >= 1) & (q <= n))
    grams = F.transform(
        fitting, lambda q: F.transform(F.sequence(F.lit(1), n - q + 1), lambda at: F.substr(form, at, q))
    )
    return F.array_distinct(F.flatten(grams))


def _signed(items: DataFrame, cutoff: int, pieces_left: bool, empty: str = "") -> DataFrame:
    """Piece rows on one side, window rows on the other. Texts without characters only meet each other."""
    form = F.col("form")
    none = F.length(form) == 0
    pieces = F.when(none, F.array(F.lit(empty))).otherwise(_pieces(form, cutoff))
    windows = F.when(none, F.array(F.lit(empty))).otherwise(_windows(form, cutoff))
    tag = F.lit("" if pieces_left else "<")
    as_pieces = items.select("pos", "form", "side", F.explode(pieces).alias("sig"), F.lit(True).alias("piece"))
    as_windows = items.select("pos", "form", "side", F.explode(windows).alias("sig"), F.lit(False).alias("piece"))
    return as_pieces.unionAll(as_windows).withColumn("sig", F.concat(tag, "sig"))


def signatures(items: DataFrame, cutoff: int, two_sided: bool) -> DataFrame:
    """``sig, pos, is_left, is_right, form`` rows under which every pair above the cutoff meets."""
    if not two_sided:
        rows = _signed(items, cutoff, True)
        return rows.select("sig", "pos", F.col("piece").alias("is_left"), (~F.col("piece")).alias("is_right"), "form")
    mine = F.col("side") == "a"
    down = _signed(items, cutoff, True).filter(mine == F.col("piece"))  # the left text is the longer
    up = _signed(items, cutoff, False).filter(mine != F.col("piece"))  # the right text is the longer
    return down.unionAll(up).select("sig", "pos", mine.alias("is_left"), (~mine).alias("is_right"), "form")


# --- joins ----------------------------------------------------------------------------------------


def sorted_forms(keys: DataFrame) -> DataFrame:
    return keys.select("pos", token_sort_form(F.col("key")).alias("form"))


def _forms(keys: DataFrame, side: str) -> DataFrame:
    return sorted_forms(keys).withColumn("side", F.lit(side))


def _length_reach(cutoff: int):
    return lambda low, high: (-(-low * cutoff // (200 - cutoff)), high * (200 - cutoff) // cutoff)


def _indel_distances(table: pa.Table, pivots: pa.Table) -> np.ndarray:
    n, k = table.num_rows, pivots.num_rows
    texts = Texts(table["form"].to_pylist() + pivots["form"].to_pylist())
    i, j = np.repeat(np.arange(n), k), np.tile(np.arange(n, n + k), n)
    return (texts.lengths[i] + texts.lengths[j] - 2 * lcs_lengths(texts, i, j)).reshape(n, k)


def _allowed(score):
    return (100.0 - score) / 100.0, np.zeros(1)[0]


#: Insertions and deletions between sorted forms; a pair at score s is (100 - s) % of both lengths apart.
INDEL = Space(
    measure=_indel_distances,
    sizes=lambda table: pc.utf8_length(table["form"].combine_chunks()).to_numpy(zero_copy_only=False),
    allowed=_allowed,
    grain=64,
)


def _deletions_pay(counts: list[tuple[int, int, int]], cutoff: int, avg: float, weights: Weights) -> bool:
    """Deletions move little beside what all pairs cost, and can settle most items."""
    looks = blocks.Cost(blocks.band_cost(counts, _length_reach(cutoff), False) * weights.look, 0.0).seconds()
    moved = blocks.Cost(0.0, sum((band + 1) * (band + 24) * n for band, n, _ in counts)).seconds()
    return looks > blocks.DIRECT_SECONDS / 6 and 4 * moved < looks and deletions.settles(counts, cutoff) > 0.5


def _pairs(items: DataFrame, cutoff: int, k: int, two_sided: bool, route: str, meter: Accumulator | None) -> DataFrame:
    if route in ("signatures", "split") and cutoff <= 50:
        raise ValueError("no signature holds at a cutoff of 50")
    sides = items.select(
        "pos",
        "form",
        F.length("form").cast("long").alias("band"),
        (F.col("side") == "a").alias("is_left"),
        (F.col("side") == "b").alias("is_right") if two_sided else F.lit(True).alias("is_right"),
    )
    counts = blocks.band_counts(sides)
    total = sum(n for _, n, _ in counts)
    avg = sum(band * n for band, n, _ in counts) / max(total, 1)
    # a look is a row of the matrix product, a score one step of 64 letters for each letter of the other text
    whole = 4 + 0.6 * avg if two_sided and max((band for band, _, _ in counts), default=0) <= 64 else None
    weights = Weights(look=20 + avg / 4, score=20 * (1 + avg / 64) * avg, item_bytes=4 * avg + 64, whole=whole)
    shape = Shape(k=k, high_b=False, two_sided=two_sided)
    if not two_sided and (route == "deletions" or (route == "auto" and _deletions_pay(counts, cutoff, avg, weights))):
        closed, waiting, n = deletions.near_partners(sides, counts, shape, cutoff)
        if route == "deletions" or n <= deletions.OPEN_SHARE * total:
            layout = metric.lay_out(sides.drop("band"), INDEL, total, weights.item_bytes)
            if not n or not layout.rights:
                return closed
            return closed.unionAll(metric.one_round(layout, waiting, INDEL, fuzzy_scorer(cutoff), shape, cutoff, meter))
    return blocks.score_pairs(
        sides,
        counts,
        _length_reach(cutoff),
        (lambda: signatures(items, cutoff, two_sided)) if cutoff > 50 else None,
        fuzzy_scorer(cutoff),
        replace(shape, longer_first=not two_sided),
        blocks.chunk_rows(total, 4 * avg, items.sparkSession.sparkContext.defaultParallelism),
        mirrored=False,
        route=route,
        weights=weights,
        metric=lambda: metric.plan(sides.drop("band"), INDEL, fuzzy_scorer, shape, cutoff, total, weights, meter),
    )


def top_k_fuzzy(pairs: DataFrame, k: int) -> DataFrame:
    """Best k partners per item; equal scores go to the earlier partner."""
    return blocks.keep_top_k(pairs, k, high_b=False)


def fuzzy_self_join(keys: DataFrame, cutoff: int = 85, k: int = 5, route: str = "auto", meter: Accumulator | None = None) -> DataFrame:
    """``pos_a, pos_b, raw, rank`` over ``key, pos``; the partner always comes later than the item.

    ``meter`` adds up the pairs whose common subsequence the metric route works out.
    """
    items = materialise(_forms(keys, "a"), "forms")
    return top_k_fuzzy(_pairs(items, cutoff, k, False, route, meter), k)


def fuzzy_join(primary: DataFrame, master: DataFrame, cutoff: int = 85, k: int = 5, route: str = "auto", meter: Accumulator | None = None) -> DataFrame:
    """``pos_a, pos_b, raw, rank``: the best master keys of every primary key."""
    items = materialise(_forms(primary, "a").unionAll(_forms(master, "b")), "forms")
    return top_k_fuzzy(_pairs(items, cutoff, k, True, route, meter), k)
