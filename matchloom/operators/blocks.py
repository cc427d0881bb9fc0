"""Distributed pair scoring in bounded blocks.

A similarity join has to look at many pairs but keeps few. Here Spark decides *where* pairs meet: each
item is sent to the blocks in which it may meet a partner, a block holds a bounded number of items, and
a NumPy scorer inside the block returns only pairs above the cutoff, at most k per item. Pairs are
never rows of a shuffle before they are scored.

Several routes choose the blocks, and none loses a pair (``score_pairs`` picks by expected cost):

* ``bands``: items ordered by a band (text length) and cut into chunks; chunk pairs whose bands can
  reach the cutoff form a block. A band with too many items is split by a hash.
* ``signatures``: items that share a signature meet. A signature with too many items is split into
  chunks by a hash and all its chunk pairs become blocks of their own; rare signatures share blocks.
* ``metric``: items visit the boxes of points that they may reach, see ``metric``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.plans.scratch import materialise

CHUNK_ROWS_MIN, CHUNK_ROWS_MAX = 256, 16384
CHUNK_BYTES = 32 << 20
# core seconds below which no other plan than bands is looked at: its own passes would cost as much
DIRECT_SECONDS = 120.0
# a signature route costs a shuffle of every item's signatures; below this many pairs it never pays
DIRECT_PAIRS = 500_000_000
BROADCAST_BYTES = 8 << 20
PAIR_SCHEMA = "pos_a long, pos_b long, raw double"


@dataclass(frozen=True)
class Shape:
    """What a scorer needs to know beside the items."""

    k: int
    high_b: bool  # ties in score go to the higher partner position
    two_sided: bool
    longer_first: bool = False  # signature route: the longer text is on the left


Scorer = Callable[[pa.Table, "Groups", "Best"], None]


@dataclass(frozen=True)
class Cost:
    """What a plan is expected to take: simple operations, and bytes that move between tasks."""

    operations: float
    moved: float

    def seconds(self) -> float:
        """On one core: a billion operations, or 50 MB through a shuffle and into a worker."""
        return self.operations / 1e9 + self.moved / 5e7


@dataclass(frozen=True)
class MetricPlan:
    """A join by pivots, laid out but not run: see ``metric.plan``. ``near_pairs``: pairs that its points leave open."""

    cost: Cost
    near_pairs: float
    run: Callable[[], DataFrame]


@dataclass(frozen=True)
class Weights:
    """Operations for a pair in the first look, for a pair that is scored in full, and bytes of an item.

    ``whole``: operations for each pair where all pairs of a rectangle are scored at once; None: they never are.
    """

    look: float
    score: float
    item_bytes: float
    whole: float | None = None


class Groups:
    """The left and right rows of every meeting inside one block table."""

    #: Which pairs of the present meeting are worth a look; None: all.
    ok: np.ndarray | None = None
    #: Pairs whose score was worked out, for those who want to know.
    scored = 0

    def __init__(self, table: pa.Table, shape: Shape):
        self.pos = table["pos"].to_numpy()
        self.left = table["is_left"].to_numpy(zero_copy_only=False)
        self.right = table["is_right"].to_numpy(zero_copy_only=False)
        self.table = table
        self.shape = shape

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if "sig" not in self.table.column_names:
            yield np.flatnonzero(self.left), np.flatnonzero(self.right)
            return
        sig = pc.dictionary_encode(self.table["sig"]).combine_chunks().indices.to_numpy()
        tile = self.table["tile"].to_numpy()
        order = np.lexsort((tile, sig))
        change = (np.diff(sig[order]) != 0) | (np.diff(tile[order]) != 0)
        edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(order)]))
        has_left = np.add.reduceat(self.left[order], edges[:-1]) if len(order) else []
        has_right = np.add.reduceat(self.right[order], edges[:-1]) if len(order) else []
        for g in np.flatnonzero((np.asarray(has_left) > 0) & (np.asarray(has_right) > 0)):
            rows = order[edges[g] : edges[g + 1]]
            left, right = rows[self.left[rows]], rows[self.right[rows]]
            if len(left) > 1 or len(right) > 1 or left[0] != right[0]:
                yield left, right

    def precedence(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray | None):
        """Ranks such that a pair counts once: left rank below right rank. None: every pair counts."""
        if self.shape.two_sided:
            return None
        if self.shape.longer_first and "sig" in self.table.column_names:
            rank = np.empty(len(self.pos), np.int64)
            rows = np.unique(np.concatenate((left, right)))
            _, slot = np.unique(self.pos[rows], return_inverse=True)
            # one rank per item: the same item may sit on both sides
            rank[rows] = -lengths[rows] * (len(rows) + 1) + slot
            return rank
        if np.array_equal(left, right):
            return self.pos
        return None


def best_per_item(a, b, raw, shape: Shape):
    """Distinct pairs, then the best k per item in the order of the engine."""
    order = np.lexsort((-b if shape.high_b else b, -raw, a))
    a, b, raw = a[order], b[order], raw[order]
    if len(a) > 1:
        fresh = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0)))
        a, b, raw = a[fresh], b[fresh], raw[fresh]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(a) != 0))) if len(a) else np.array([], np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(a)]))))
    keep = rank < shape.k
    return a[keep], b[keep], raw[keep], rank[keep]


class Best:
    """The best pairs of a block so far, and per item the score that a further pair must at least reach.

    An item with k partners at or above a score can drop every pair that cannot get there. That keeps
    dense blocks cheap without losing a result: ties stay in.
    """

    def __init__(self, table: pa.Table, shape: Shape):
        self.shape = shape
        self.pos = table["pos"].to_numpy()
        items = self.pos[table["is_left"].to_numpy(zero_copy_only=False)] if shape.two_sided else self.pos
        self.items = np.unique(items)
        self.slot = np.minimum(np.searchsorted(self.items, self.pos), max(len(self.items) - 1, 0))
        self.floor = np.full(len(self.items), -np.inf)
        # the partner at the floor: among equal scores the order of positions decides
        self.worst = np.full(len(self.items), 0 if shape.high_b else np.iinfo(np.int64).max)
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray, raw: np.ndarray) -> None:
        a, b = self.pos[i], self.pos[j]
        if not self.shape.two_sided:
            a, b = np.minimum(a, b), np.maximum(a, b)
        self.waiting.append((a, b, raw))
        self.size += len(a)
        if self.size > max(50_000, len(self.kept[0])):
            self.compact()

    def compact(self) -> None:
        if not self.waiting:
            return
        a, b, raw, rank = best_per_item(*[np.concatenate(c) for c in zip(self.kept, *self.waiting)], self.shape)
        self.kept, self.waiting, self.size = (a, b, raw), [], 0
        last = rank == self.shape.k - 1
        slots = np.searchsorted(self.items, a[last])
        sound = raw[last] >= self.floor[slots]
        self.worst[slots[sound]] = b[last][sound]
        self.floor[slots] = np.maximum(self.floor[slots], raw[last])

    def part(self) -> Best:
        """For some of the items: floors are shared, pairs are kept apart until they are absorbed."""
        part = copy(self)
        part.kept, part.waiting, part.size = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0
        return part

    def absorb(self, part: Best) -> None:
        if part is self:
            return
        part.compact()
        self.waiting.append(part.kept)
        self.size += len(part.kept[0])
        if self.size > max(50_000, len(self.kept[0])):
            self.compact()

    def pair_floor(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The floor of each pair's item; i and j broadcast."""
        mine = self.floor[self.slot[i]]
        if self.shape.two_sided:
            return np.broadcast_to(mine, np.broadcast_shapes(i.shape, j.shape))
        return np.where(self.pos[i] < self.pos[j], mine, self.floor[self.slot[j]])

    def able(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Pairs that a bound of their score still lets in: above the floor, or at it with a better position."""
        floor = self.pair_floor(i, j)
        a, b = self.pos[i], self.pos[j]
        slot = self.slot[i]
        if not self.shape.two_sided:
            slot = np.where(a < b, slot, self.slot[j])
            b = np.maximum(a, b)
        better = b >= self.worst[slot] if self.shape.high_b else b <= self.worst[slot]
        return (bound > floor + 1e-6) | ((bound >= floor - 1e-6) & better)

    def raise_floors(self, rows: np.ndarray, cols: np.ndarray, lower: np.ndarray, once: np.ndarray | None) -> None:
        """Lower bounds of all scores of a rectangle already tell what k partners reach."""

        def lift(slots: np.ndarray, bounds: np.ndarray) -> None:
            if bounds.shape[1] >= self.shape.k:
                at = bounds.shape[1] - self.shape.k
                np.maximum.at(self.floor, slots, np.partition(bounds, at, axis=1)[:, at])

        valid = lower if once is None else np.where(once, lower, -np.inf)
        if self.shape.two_sided:
            lift(self.slot[rows], valid)
            return
        first = self.pos[rows][:, None] < self.pos[cols][None, :]
        if first.any():
            lift(self.slot[rows], np.where(first, valid, -np.inf))
        if not first.all():
            lift(self.slot[cols], np.where(first, -np.inf, valid).T)


def score_block(scorer: Scorer, shape: Shape) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        best = Best(table, shape)
        scorer(table, Groups(table, shape), best)
        best.compact()
        a, b, raw = best.kept
        return pa.table({"pos_a": a, "pos_b": b, "raw": raw})

    return run


def sub_blocks(left, right, rank, rows_left: int, rows_right: int, first_right: int | None = None):
    """Cut one meeting into cache-sized rectangles, skipping those below the diagonal.

    ``first_right``: the first rectangles of a row are that wide, and later ones four times as wide as those before.
    """
    if rank is not None:
        left, right = left[np.argsort(rank[left])], right[np.argsort(rank[right])]
    for at in range(0, len(left), rows_left):
        some = left[at : at + rows_left]
        to, wide = 0, first_right or rows_right
        while to < len(right):
            wide = min(wide, rows_right)
            other = right[to : to + wide]
            to, wide = to + wide, 4 * wide
            if rank is not None and rank[some[0]] >= rank[other[-1]]:
                continue
            yield some, other, None if rank is None else rank[some][:, None] < rank[other][None, :]


# --- planning -----------------------------------------------------------------------------------


def chunk_rows(total: int, avg_bytes: float, parallelism: int) -> int:
    """Small enough to keep every core busy, large enough not to copy items too often, and bounded."""
    wanted = math.ceil(total / max(1.0, math.sqrt(4 * parallelism)))
    bounded = min(CHUNK_ROWS_MAX, int(CHUNK_BYTES / max(1.0, avg_bytes)))
    return max(1, min(max(wanted, CHUNK_ROWS_MIN), bounded))


def _chunks(counts: Iterable[tuple[int, int]], limit: int):
    """``(band, first_chunk, splits)`` of the ordered bands, and the lowest and highest band of each chunk."""
    edges: list[tuple[int, int]] = []
    spans: list[tuple[int, int, int]] = []
    room = 0
    for band, n in sorted(counts):
        if n > limit:
            splits = math.ceil(n / limit)
            spans.append((band, len(edges), splits))
            edges += [(band, band)] * splits
            room = 0
        elif edges and n <= room:
            edges[-1] = (edges[-1][0], band)
            spans.append((band, len(edges) - 1, 1))
            room -= n
        else:
            spans.append((band, len(edges), 1))
            edges.append((band, band))
            room = limit - n
    return spans, edges


def _meeting(spans, edges, others, reach: Callable[[int, int], tuple[int, int]]):
    """``spans`` with the lowest and highest chunk of ``others`` that each may meet; those that meet none go."""
    lows, highs = [e[0] for e in others], [e[1] for e in others]
    out = []
    for band, first, splits in spans:
        low, high = reach(*edges[first])
        low, high = bisect_left(highs, low), bisect_right(lows, high) - 1
        if low <= high:
            out.append((band, first, splits, low, high))
    return out


def band_plan(counts: Iterable[tuple[int, int]], reach: Callable[[int, int], tuple[int, int]], limit: int):
    """Chunks over the ordered bands: ``(band, first_chunk, splits, lowest_partner, highest_partner)``."""
    spans, edges = _chunks(counts, limit)
    return _meeting(spans, edges, edges, reach), len(edges)


def side_plans(counts: Iterable[tuple[int, int, int]], reach: Callable[[int, int], tuple[int, int]], limit: int):
    """The same with chunks of each side's own, from ``(band, items, items on the left)``: a small side is in few."""
    counts = list(counts)
    left, left_edges = _chunks([(band, a) for band, _, a in counts if a], limit)
    right, right_edges = _chunks([(band, n - a) for band, n, a in counts if n > a], limit)
    return _meeting(left, left_edges, right_edges, reach), _meeting(right, right_edges, left_edges, reach), len(left_edges), len(right_edges)


def band_cost(counts: Iterable[tuple[int, int, int]], reach: Callable[[int, int], tuple[int, int]], two_sided: bool) -> float:
    """Pairs whose bands can reach the cutoff, from ``(band, items, items on the left)``."""
    ordered = sorted(counts)
    bands = [b for b, _, _ in ordered]
    others = [n - a if two_sided else n for _, n, a in ordered]
    below = [0, *accumulate(others)]
    total = 0.0
    for band, n, a in ordered:
        low, high = reach(band, band)
        near = below[bisect_right(bands, high)] - below[bisect_left(bands, low)]
        total += a * near if two_sided else n * near / 2
    return total


def band_moves(counts: Iterable[tuple[int, int, int]], reach: Callable[[int, int], tuple[int, int]], limit: int, two_sided: bool) -> float:
    """Rows that the bands send: each item once for each chunk that it may meet."""
    counts = list(counts)
    if two_sided:
        left, right, _, _ = side_plans(counts, reach, limit)
        sides = [(left, {band: a for band, _, a in counts}), (right, {band: n - a for band, n, a in counts})]
    else:
        spans, _ = band_plan([(band, n) for band, n, _ in counts], reach, limit)
        sides = [(spans, {band: n for band, n, _ in counts})]
    return float(sum(items[band] * (high - low + 1) for spans, items in sides for band, _, _, low, high in spans))


def _partition_count(df: DataFrame, blocks: int) -> int:
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(blocks, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _score(df: DataFrame, scorer: Scorer, shape: Shape, blocks: int) -> DataFrame:
    # an explicit count keeps the runtime from merging small but compute-heavy partitions
    spread = df.repartition(_partition_count(df, blocks), "block")
    return spread.groupBy("block").applyInArrow(score_block(scorer, shape), PAIR_SCHEMA)


def by_bands(items: DataFrame, counts, reach, scorer: Scorer, shape: Shape, limit: int) -> DataFrame:
    """``items``: pos, is_left, is_right, band and the payload; one row per item and side. ``counts``: as from ``band_counts``."""
    spark = items.sparkSession
    if shape.two_sided:
        left, right, n_left, n_right = side_plans(counts, reach, limit)
        spans = [(*s, True) for s in left] + [(*s, False) for s in right]
        on = ["band", "is_left"]
    else:
        spans, n_left = band_plan([(band, n) for band, n, _ in counts], reach, limit)
        spans, n_right, on = [(*s, True) for s in spans], n_left, ["band"]
    # one row per distinct band (text length): bounded by the longest text, not by the data
    table = spark.createDataFrame(spans, "band long, first int, splits int, low int, high int, is_left boolean")
    if not shape.two_sided:
        table = table.drop("is_left")
    if 40 * len(spans) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    placed = (
        items.join(table, on)
        .withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("pos"), F.col("splits")).cast("int"))
        .withColumn("other", F.explode(F.sequence("low", "high")))
    )
    me, you = F.col("chunk").cast("long"), F.col("other").cast("long")
    if shape.two_sided:
        top, bottom = F.when(F.col("is_left"), me).otherwise(you), F.when(F.col("is_left"), you).otherwise(me)
        sides = (F.col("is_left"), F.col("is_right"))
    else:
        top, bottom = F.least(me, you), F.greatest(me, you)
        sides = (me == top, me == bottom)
    payload = [c for c in items.columns if c not in ("pos", "is_left", "is_right", "band")]
    blocks = placed.select(
        (top * n_right + bottom).alias("block"), "pos", sides[0].alias("is_left"), sides[1].alias("is_right"), *payload
    )
    return _score(blocks, scorer, shape, n_left * n_right)


def signature_stats(signed: DataFrame) -> DataFrame:
    """Items per signature and side; partial aggregation absorbs the frequent ones."""
    return materialise(
        signed.groupBy("sig").agg(
            F.sum(F.col("is_left").cast("long")).alias("n_left"),
            F.sum(F.col("is_right").cast("long")).alias("n_right"),
        ),
        "signature-counts",
    )


def _pairs_of(mirrored: bool) -> Column:
    pairs = F.col("n_left").cast("double") * F.col("n_right")
    return pairs / 2 if mirrored else pairs


def _is_hot(limit: int) -> Column:
    """More pairs than one block holds; then one side has more than ``limit`` items, so few can be hot."""
    return F.col("n_left").cast("double") * F.col("n_right") > float(limit) * limit


def signature_cost(stats: DataFrame, mirrored: bool, limit: int) -> tuple[float, float, int]:
    """Pairs that would be scored, those of hot signatures among them, and rows that would move."""
    pairs = _pairs_of(mirrored)
    rows = F.col("n_left") if mirrored else F.col("n_left") + F.col("n_right")
    got = stats.agg(
        F.sum(pairs).alias("p"), F.sum(F.when(_is_hot(limit), pairs)).alias("h"), F.sum(rows).alias("r")
    ).first()
    return got["p"] or 0.0, got["h"] or 0.0, got["r"] or 0


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of hot signatures, at most rows / limit of them, if its checked size allows."""
    wide = F.sum(F.octet_length(F.col("sig").cast("string")) + 40)
    return F.broadcast(df) if (df.agg(wide).first()[0] or 0) <= BROADCAST_BYTES else df


def by_signatures(signed: DataFrame, stats: DataFrame, rows: int, scorer: Scorer, shape: Shape, limit: int) -> DataFrame:
    """``signed``: sig, pos, is_left, is_right and the payload. Rows on both sides meet as a triangle."""
    hot = stats.filter((F.col("n_left") > limit) | (F.col("n_right") > limit)).select(
        "sig",
        F.ceil(F.col("n_left") / limit).cast("int").alias("s_left"),
        F.ceil(F.col("n_right") / limit).cast("int").alias("s_right"),
    )
    hot = _small(hot)
    both = F.col("is_left") & F.col("is_right")
    mine = F.greatest(F.when(F.col("is_left"), F.col("s_left")).otherwise(F.col("s_right")), F.lit(1))
    yours = F.greatest(
        F.when(both, F.col("s_left")).when(F.col("is_left"), F.col("s_right")).otherwise(F.col("s_left")), F.lit(1)
    )
    placed = (
        signed.join(hot, "sig", "left")
        .withColumn("mine", F.coalesce(mine, F.lit(1)))
        .withColumn("yours", F.coalesce(yours, F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("pos"), F.col("mine")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("yours") - 1)))
    )
    me, you = F.col("chunk").cast("long"), F.col("other").cast("long")
    low, high = F.least(me, you), F.greatest(me, you)
    tile = (
        F.when(both, low * F.col("mine") + high)
        .when(F.col("is_left"), me * F.col("yours") + you)
        .otherwise(you * F.col("mine") + me)
    )
    shared = max(1, rows // 4096)
    block = F.when(F.col("s_left").isNull(), F.pmod(F.xxhash64("sig"), F.lit(shared))).otherwise(
        F.xxhash64("sig", "tile")
    )
    payload = [c for c in signed.columns if c not in ("sig", "pos", "is_left", "is_right")]
    blocks = placed.withColumn("tile", tile).select(
        block.alias("block"),
        "sig",
        "tile",
        "pos",
        F.when(both, me == low).otherwise(F.col("is_left")).alias("is_left"),
        F.when(both, me == high).otherwise(F.col("is_right")).alias("is_right"),
        *payload,
    )
    return _score(blocks, scorer, shape, max(4 * signed.sparkSession.sparkContext.defaultParallelism, rows // 512))


def band_counts(items: DataFrame) -> list[tuple[int, int, int]]:
    """``(band, items, items on the left)``; a band is a text length, so the longest text bounds the list."""
    counted = items.groupBy("band").agg(F.count("*").alias("n"), F.count_if("is_left").alias("a"))
    return [(r["band"], r["n"], r["a"]) for r in counted.collect()]


def score_pairs(
    items: DataFrame,
    counts: list[tuple[int, int, int]],
    reach: Callable[[int, int], tuple[int, int]],
    signed: Callable[[], DataFrame] | None,
    scorer: Scorer,
    shape: Shape,
    limit: int,
    mirrored: bool,
    route: str,
    weights: Weights,
    metric: Callable[[], MetricPlan],
) -> DataFrame:
    """Score all pairs that can reach the cutoff, by the plan that is expected to cost least.

    ``items`` carry pos, is_left, is_right, band and the payload. Beside bands, signatures and the metric plan there
    is ``split``, for skew: items that share any hot signature meet once by bands, not once per hot signature, and
    only the other signatures are used as such.
    """

    def bands(some: DataFrame, n: list[tuple[int, int, int]]) -> DataFrame:
        return by_bands(some, n, reach, scorer, shape, limit)

    in_bands = band_cost(counts, reach, shape.two_sided)
    moves = band_moves(counts, reach, limit, shape.two_sided)
    plain = Cost(in_bands * weights.look, moves * weights.item_bytes)
    if route == "bands" or (route == "auto" and plain.seconds() <= DIRECT_SECONDS):
        return bands(items, counts)
    costs: dict[str, float] = {}
    if route in ("auto", "metric"):
        plan = metric()
        if route == "metric":
            return plan.run()
        # by bands, too, all pairs that the points leave open are scored
        looked = plain.seconds() + plan.near_pairs * weights.score / 1e9
        whole = math.inf if weights.whole is None else Cost(in_bands * weights.whole, plain.moved).seconds()
        costs = {"bands": min(looked, whole), "metric": plan.cost.seconds()}
    if signed is None or (route == "auto" and in_bands <= DIRECT_PAIRS):
        return plan.run() if costs["metric"] < costs["bands"] else bands(items, counts)
    rows_of = signed()
    stats = signature_stats(rows_of)
    cost, hot_cost, rows = signature_cost(stats, mirrored, limit)

    def seconds(pairs: float) -> float:
        return Cost(pairs * (weights.look + weights.score), rows * weights.item_bytes).seconds()

    costs["signatures"] = seconds(cost)
    if route == "split" or (route == "auto" and hot_cost > 0):
        hot = _small(stats.filter(_is_hot(limit)).select("sig"))
        ids = ["pos", "is_left"] if shape.two_sided else ["pos"]
        touched = rows_of.join(hot, "sig", "left_semi").select(*ids).distinct()
        hot_items = materialise(items.join(touched, ids, "left_semi"), "hot-items")
        hot_counts = band_counts(hot_items)
        costs["split"] = seconds(cost - hot_cost) + band_cost(hot_counts, reach, shape.two_sided) * weights.look / 1e9
    chosen = min(costs, key=costs.get) if route == "auto" else route
    if chosen == "metric":
        return plan.run()
    if chosen == "bands":
        return bands(items, counts)
    if chosen == "signatures":
        return by_signatures(rows_of, stats, rows, scorer, shape, limit)
    cold = rows_of.join(hot, "sig", "left_anti")
    rest = by_signatures(cold, stats.filter(~_is_hot(limit)), rows, scorer, shape, limit)
    return rest.unionAll(bands(hot_items, hot_counts))


def keep_top_k(pairs: DataFrame, k: int, high_b: bool) -> DataFrame:
    """Drop repeats of a pair and rank; one shuffle, on the item."""
    order = [F.desc("raw"), F.desc("pos_b") if high_b else F.asc("pos_b")]
    return (
        pairs.repartition("pos_a")
        .groupBy("pos_a", "pos_b")
        .agg(F.max("raw").alias("raw"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("pos_a").orderBy(*order)))
        .filter(F.col("rank") <= k)
    )
