"""Exact similarity joins through distances to pivots.

Both engines rank by a metric: insertions and deletions between two texts, and the angle between two vectors. So two
items are at least as far apart as their distances to any pivot differ. Each item gets its distances to a few pivots,
a *point*; a pair can only reach the cutoff if its points differ by no more than the cutoff allows in every place.

1. Pivots are picked far apart from a bounded sample. One pass gives every item its point.
2. A bounded sample of points is cut into leaves by a k-d tree; one pass finds the exact box, size and number of each
   leaf's items. The sample decides where items meet, never whether: boxes are those of all items.
3. An item visits the leaves whose box it may reach. A leaf with many items or visitors is cut into tiles by hash, so
   that a group is bounded. No side is broadcast, and no pair is a row before it is scored.
4. In a group the boxes are split further, and the pairs left are compared point by point before any is scored. An
   item with k partners asks for more than the worst of them, so later boxes are pruned by that.
5. If many partners are to be expected, a first round runs at a higher cutoff, where boxes reach less far. Items that
   find k partners there are done: a partner below the higher cutoff could not displace any. The others go on.

Leaves and pivots are bounded by constants, so what a task is told does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import blocks
from matchloom.operators.blocks import Best, Cost, Groups, MetricPlan, Scorer, Shape, Weights
from matchloom.plans.scratch import materialise

PIVOTS = 32
#: Items among which pivots are picked, and points from which the tree is cut.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_POINTS = 1024, 8 << 20, 32_768
LEAVES, LEAF_ROWS = 4096, 256
#: Points of either side from which the number of partners is estimated.
_ESTIMATE = 1024
SLACK = 1e-6
#: Rows of either side whose points are compared at once.
_SIDE = 1024
#: Operations for one place of a pair of points.
_LOOK = 1.5


@dataclass(frozen=True)
class Space:
    """A metric over the payload columns of items.

    ``measure`` gives the distances of all rows of a table to the rows of another; ``sizes`` what the allowed distance
    depends on; ``allowed`` turns least scores into ``slope, flat``: a pair may be ``slope * (size + size) + flat`` apart.
    """

    measure: Callable[[pa.Table, pa.Table], np.ndarray]
    sizes: Callable[[pa.Table], np.ndarray]
    allowed: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: Right-hand items of a box inside a group below which it is not split.
    grain: int


# --- pivots and points ------------------------------------------------------------------------------


def pick_pivots(space: Space, sample: pa.Table, count: int = PIVOTS) -> pa.Table:
    """Rows far from each other: each next one is the farthest from those before; repeats end the list."""
    chosen, far = [0], None
    while len(chosen) < min(count, sample.num_rows):
        d = space.measure(sample, sample.slice(chosen[-1], 1))[:, 0]
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample.take(chosen)


def points_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Points as rows of numbers; they travel as bytes."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1) if values else np.empty((0, 1), np.float32)


def pointer(space: Space, pivots: pa.Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = space.sizes(table).astype(np.int64)
            # the size is the distance to an empty text; where it is 0 for all it takes no part
            points = np.column_stack((sizes, space.measure(table, pivots))).astype(np.float32)
            arrays = [*batch.columns, pa.array(sizes), pa.array([p.tobytes() for p in points], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "reach_size", "point"])

    return run


def _some(df: DataFrame, rows: int, of: int) -> pa.Table:
    """About so many rows, picked by a hash of their position."""
    ratio = max(1, math.ceil(of / rows))
    return df.filter(F.pmod(F.xxhash64("pos"), F.lit(ratio)) == 0).toArrow()


# --- the tree ---------------------------------------------------------------------------------------


class Tree:
    """Planes over points; leaves are numbered in the order in which they are cut. Boxes are filled in later."""

    def __init__(self, points: np.ndarray, least: int):
        self.place, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.leaves = 0
        waiting = [(self._node(), np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            mine = points[rows]
            place = int((mine.max(axis=0) - mine.min(axis=0)).argmax()) if len(rows) else 0
            cut = float(np.median(mine[:, place])) if len(rows) else 0.0
            below = mine[:, place] <= cut
            if len(rows) < 2 * least or below.all():
                below = mine[:, place] < cut
            if len(rows) < 2 * least or not below.any():
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.place[node], self.cut[node] = place, float(mine[below, place].max())
            self.left[node], self.right[node] = self._node(), self._node()
            waiting += [(self.left[node], rows[below]), (self.right[node], rows[~below])]

    def _node(self) -> int:
        for values in (self.place, self.cut, self.left, self.right, self.leaf):
            values.append(-1)
        return len(self.leaf) - 1

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, waiting = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                below = points[rows, self.place[node]] <= self.cut[node]
                waiting += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out

    def fill(self, boxes: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Give leaves the box and largest size of their items, and inner nodes those of all below; others stay empty."""
        self.box: list[tuple | None] = [None] * len(self.leaf)
        for node in reversed(range(len(self.leaf))):
            if self.leaf[node] >= 0:
                self.box[node] = boxes.get(self.leaf[node])
                continue
            below = [b for b in (self.box[self.left[node]], self.box[self.right[node]]) if b]
            if below:
                lows, highs, sizes = zip(*below)
                self.box[node] = (np.minimum.reduce(lows), np.maximum.reduce(highs), max(sizes))

    def visits(self, points: np.ndarray, sizes: np.ndarray, slope: float, flat: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows that may have partners there."""
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if self.box[node] is None or not len(rows):
                continue
            low, high, most = self.box[node]
            rows = rows[box_gap(points[rows], low, high) <= slope * (sizes[rows] + most) + flat]
            if self.leaf[node] < 0:
                waiting += [(self.left[node], rows), (self.right[node], rows)]
            elif len(rows):
                yield self.leaf[node], rows


def box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far at least each point is from all in a box, in the place where they differ most."""
    return np.maximum(np.maximum(low - points, points - high).max(axis=1), 0.0)


_BOX = "leaf int, n long, size long, low binary, high binary"


def _boxes(tree: Tree):
    """Box, size and number of right-hand items of each leaf, one row for each task and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            points, sizes = points_of(batch["point"]), batch["reach_size"].to_numpy()
            home = tree.home(points)
            for leaf in np.unique(home):
                rows = np.flatnonzero(home == leaf)
                mine = [len(rows), int(sizes[rows].max()), points[rows].min(axis=0), points[rows].max(axis=0)]
                old = found.setdefault(int(leaf), mine)
                if old is not mine:
                    found[int(leaf)] = [old[0] + mine[0], max(old[1], mine[1]), np.minimum(old[2], mine[2]), np.maximum(old[3], mine[3])]
        rows = [(leaf, n, size, low.tobytes(), high.tobytes()) for leaf, (n, size, low, high) in found.items()]
        yield _box_rows(rows)

    return run


def _box_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("leaf", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


def _merge_boxes(table: pa.Table) -> pa.Table:
    low, high = points_of(table["low"]).min(axis=0), points_of(table["high"]).max(axis=0)
    row = (table["leaf"][0].as_py(), sum(table["n"].to_pylist()), max(table["size"].to_pylist()), low.tobytes(), high.tobytes())
    return pa.Table.from_batches([_box_rows([row])])


# --- routing ----------------------------------------------------------------------------------------


def dealt(pos: np.ndarray, parts: int) -> np.ndarray:
    return ((pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _visit_counts(tree: Tree, slope: float, flat: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(tree.leaves, np.int64)
        for batch in batches:
            for leaf, rows in tree.visits(points_of(batch["point"]), batch["reach_size"].to_numpy(), slope, flat):
                counts[leaf] += len(rows)
        leaves = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), pa.array(counts[leaves])], names=["leaf", "n"])

    return run


def _router(tree: Tree, slope: float, flat: float, tiles: dict[int, tuple[int, int]], columns: list[str]):
    """Rows of groups: right-hand items in the tiles of their leaf, left-hand ones in those of every leaf they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes, pos = points_of(batch["point"]), batch["reach_size"].to_numpy(), batch["pos"].to_numpy()
            is_left, is_right = (batch[c].to_numpy(zero_copy_only=False) for c in ("is_left", "is_right"))
            picked, block, left = [], [], []

            def place(leaf: int, rows: np.ndarray, on_left: bool) -> None:
                if leaf not in tiles:  # nobody visits it
                    return
                lefts, rights = tiles[leaf]
                mine, others = (lefts, rights) if on_left else (rights, lefts)
                chunk = dealt(pos[rows], mine)
                for other in range(others):
                    picked.append(rows)
                    tile = chunk * rights + other if on_left else other * rights + chunk
                    block.append((leaf << 32) + tile)
                    left.append(np.full(len(rows), on_left))

            lefts = np.flatnonzero(is_left)
            for leaf, rows in tree.visits(points[lefts], sizes[lefts], slope, flat):
                place(leaf, lefts[rows], True)
            rights = np.flatnonzero(is_right)
            home = tree.home(points[rights])
            for leaf in np.unique(home):
                place(int(leaf), rights[home == leaf], False)
            if not picked:
                continue
            rows, on_left = np.concatenate(picked), np.concatenate(left)
            taken = pa.Table.from_batches([batch]).select(columns).take(pa.array(rows))
            arrays = [pa.array(np.concatenate(block).astype(np.int64)), pa.array(on_left), pa.array(~on_left), *taken.columns]
            yield from pa.Table.from_arrays(arrays, names=["block", "is_left", "is_right", *columns]).to_batches()

    return run


# --- inside a group ---------------------------------------------------------------------------------


class Meetings(Groups):
    """Left and right rows that may be partners: boxes of right rows, split until small, with the left rows they allow."""

    def __init__(self, table: pa.Table, shape: Shape, space: Space, cutoff: float, best: Best):
        super().__init__(table, shape)
        self.points, self.sizes = points_of(table["point"]), table["reach_size"].to_numpy()
        self.space, self.cutoff, self.best = space, cutoff, best

    def allowed(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the cutoff, and the k-th partner of each left row so far, allow."""
        floors = np.maximum(self.best.floor[self.best.slot[left]], self.cutoff)
        slope, flat = self.space.allowed(floors)
        return np.broadcast_to(slope, len(left)), np.broadcast_to(flat, len(left)) + SLACK

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of points are close enough, as a table of left by right rows."""
        slope, flat = self.allowed(left)
        limit = slope[:, None] * (self.sizes[left][:, None] + self.sizes[right][None, :]) + flat[:, None]
        ok = np.ones((len(left), len(right)), bool)
        if not self.shape.two_sided:
            ok = self.pos[left][:, None] < self.pos[right][None, :]
        a, b = self.points[left], self.points[right]
        for place in range(a.shape[1]):
            ok &= np.abs(a[:, place][:, None] - b[:, place][None, :]) <= limit
        return ok

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        waiting = [(np.flatnonzero(self.left), np.flatnonzero(self.right))]
        done = 0
        while waiting:
            left, right = waiting.pop()
            if not len(left) or not len(right):
                continue
            mine = self.points[right]
            low, high = mine.min(axis=0), mine.max(axis=0)
            slope, flat = self.allowed(left)
            left = left[box_gap(self.points[left], low, high) <= slope * (self.sizes[left] + self.sizes[right].max()) + flat]
            if not self.shape.two_sided:
                left = left[self.pos[left] < self.pos[right].max()]
            if not len(left):
                continue
            if len(right) > self.space.grain and (high > low).any():
                place = int((high - low).argmax())
                cut = np.median(mine[:, place])
                below = mine[:, place] <= cut
                if below.all():
                    below = mine[:, place] < cut
                halves = [(left, right[~below]), (left, right[below])]
                waiting += halves
                continue
            done += 1
            if done % 4 == 0:
                self.best.compact()
            for at in range(0, len(left), _SIDE):
                for to in range(0, len(right), _SIDE):
                    some, other = left[at : at + _SIDE], right[to : to + _SIDE]
                    ok = self.near(some, other)
                    a, b = ok.any(axis=1), ok.any(axis=0)
                    if a.any():
                        self.ok = ok[a][:, b]
                        yield some[a], other[b]

    def precedence(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray | None):
        return None if self.shape.two_sided else self.pos


def score_block(scorer: Scorer, shape: Shape, space: Space, cutoff: float, meter: Accumulator | None):
    def run(table: pa.Table) -> pa.Table:
        best = Best(table, shape)
        meetings = Meetings(table, shape, space, cutoff, best)
        scorer(table, meetings, best)
        best.compact()
        if meter is not None:
            meter.add(meetings.scored)
        a, b, raw = best.kept
        return pa.table({"pos_a": a, "pos_b": b, "raw": raw})

    return run


# --- the join ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Items with their points, stored, and the tree over them."""

    items: DataFrame
    tree: Tree
    boxes: dict[int, tuple[np.ndarray, np.ndarray, int]]
    rights: dict[int, int]
    n: int
    avg_bytes: float
    pivots: pa.Table
    sample: np.ndarray
    sample_sizes: np.ndarray


def lay_out(items: DataFrame, space: Space, n: int, avg_bytes: float) -> Layout:
    """``items``: pos, is_left, is_right and the payload, stored; ``n`` rows of ``avg_bytes`` on average."""
    rows = max(16, min(SAMPLE_ROWS, int(SAMPLE_BYTES / max(avg_bytes, 1.0))))
    sample = _some(items, rows, n)
    if not sample.num_rows:
        sample = items.limit(1).toArrow()
    pivots = pick_pivots(space, sample) if sample.num_rows else sample
    schema = T.StructType([*items.schema.fields, T.StructField("reach_size", T.LongType()), T.StructField("point", T.BinaryType())])
    if not sample.num_rows:
        return Layout(items, Tree(np.empty((0, 1), np.float32), 1), {}, {}, 0, avg_bytes, sample, np.empty((0, 1)), np.empty(0))
    stored = materialise(items.mapInArrow(pointer(space, pivots), schema), "points")
    some = _some(stored.select("pos", "point", "reach_size"), SAMPLE_POINTS, n)
    points, sizes = points_of(some["point"]), some["reach_size"].to_numpy()
    leaves = min(LEAVES, max(1, n // LEAF_ROWS))
    tree = Tree(points, max(1, len(points) // (2 * leaves)))
    # a row for each leaf at most
    merged = stored.filter("is_right").select("point", "reach_size").mapInArrow(_boxes(tree), _BOX).groupBy("leaf").applyInArrow(_merge_boxes, _BOX)
    boxes, rights = {}, {}
    for r in merged.collect():
        boxes[r["leaf"]] = (np.frombuffer(r["low"], np.float32), np.frombuffer(r["high"], np.float32), r["size"])
        rights[r["leaf"]] = r["n"]
    tree.fill(boxes)
    return Layout(stored, tree, boxes, rights, n, avg_bytes, pivots, points[:_ESTIMATE], sizes[:_ESTIMATE])


def expected_partners(layout: Layout, space: Space, cutoff: float) -> float:
    """Items within the points' reach of an item on average, by the sample: at least as many as its partners."""
    points, sizes = layout.sample, layout.sample_sizes
    if len(points) < 2:
        return 0.0
    slope, flat = (float(x) for x in space.allowed(np.float64(cutoff)))
    near = 0
    for at in range(0, len(points), 64):
        gap = np.abs(points[at : at + 64, None, :] - points[None, :, :]).max(axis=2)
        near += int((gap <= slope * (sizes[at : at + 64, None] + sizes[None, :]) + flat + SLACK).sum())
    return (near / len(points) - 1) / len(points) * sum(layout.rights.values())


def first_cutoff(layout: Layout, space: Space, cutoff: float, k: int, two_sided: bool) -> float | None:
    """A higher cutoff at which most items should still find k partners; None if a round of its own would not pay."""
    share = 1.0 if two_sided else 0.5
    if share * expected_partners(layout, space, cutoff) < 16 * k:
        return None
    for c in range(99, math.ceil(cutoff) + 1, -1):
        if share * expected_partners(layout, space, c) >= 2 * k:
            return float(c)
    return None


def one_round(layout: Layout, lefts: DataFrame | None, space: Space, scorer: Scorer, shape: Shape, cutoff: float, meter: Accumulator | None) -> DataFrame:
    """Pairs at or above a cutoff, k per item and group. ``lefts``: positions that still look for partners; None is all."""
    slope, flat = (float(x) for x in space.allowed(np.float64(cutoff)))
    flat += SLACK
    items = layout.items
    if lefts is not None:
        # rights stay as they are; only the positions that go on are joined
        going = items.filter("is_left").join(lefts, "pos", "left_semi").withColumn("is_right", F.lit(False))
        items = items.filter("is_right").withColumn("is_left", F.lit(False)).unionAll(going.select(items.columns))
    counted = items.filter("is_left").select("point", "reach_size").mapInArrow(_visit_counts(layout.tree, slope, flat), "leaf int, n long")
    visitors = {r["leaf"]: r["n"] for r in counted.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    most = max(1, min(blocks.CHUNK_ROWS_MAX, int(blocks.CHUNK_BYTES / max(layout.avg_bytes, 1.0))))
    tiles = {leaf: (-(-n // most), -(-layout.rights.get(leaf, 0) // most) or 1) for leaf, n in visitors.items()}
    columns = [c for c in items.columns if c not in ("is_left", "is_right")]
    schema = "block long, is_left boolean, is_right boolean, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(columns).schema)
    routed = items.mapInArrow(_router(layout.tree, slope, flat, tiles, columns), schema)
    groups = max(1, sum(a * b for a, b in tiles.values()))
    spread = routed.repartition(blocks._partition_count(items, groups), "block")
    return spread.groupBy("block").applyInArrow(score_block(scorer, shape, space, cutoff, meter), blocks.PAIR_SCHEMA)


def run(layout: Layout, first: float | None, space: Space, scorer_at: Callable[[float], Scorer], shape: Shape, cutoff: float, meter: Accumulator | None) -> DataFrame:
    """``pos_a, pos_b, raw``: at least the best k pairs of every item at or above the cutoff; repeats may occur."""
    if first is None:
        return one_round(layout, None, space, scorer_at(cutoff), shape, cutoff, meter)
    found = one_round(layout, None, space, scorer_at(first), shape, first, meter)
    ranked = materialise(blocks.keep_top_k(found, shape.k, shape.high_b), "first-round")
    done = ranked.filter(F.col("rank") == shape.k).select(F.col("pos_a").alias("pos"))
    open_items = materialise(layout.items.filter("is_left").select("pos").join(done, "pos", "left_anti"), "open-items")
    rest = one_round(layout, open_items, space, scorer_at(cutoff), shape, cutoff, meter)
    closed = ranked.join(done, F.col("pos_a") == F.col("pos"), "left_semi").select("pos_a", "pos_b", "raw")
    return closed.unionAll(rest)


def expected_cost(layout: Layout, space: Space, cutoff: float, weights: Weights, two_sided: bool) -> Cost:
    """One round, by the visits that the sample would make."""
    points, sizes = layout.sample, layout.sample_sizes
    slope, flat = (float(x) for x in space.allowed(np.float64(cutoff)))
    visits = met = 0
    for leaf, rows in layout.tree.visits(points, sizes, slope, flat + SLACK):
        visits += len(rows)
        met += len(rows) * layout.rights.get(leaf, 0)
    scale = layout.n / max(len(points), 1)
    share = 1.0 if two_sided else 0.5
    looks = met * scale * share * points.shape[1] * _LOOK
    scores = expected_partners(layout, space, cutoff) * layout.n * share * weights.score
    return Cost(looks + scores + layout.n * points.shape[1] * weights.score, (visits * scale + layout.n) * weights.item_bytes)


def plan(items: DataFrame, space: Space, scorer_at: Callable[[float], Scorer], shape: Shape, cutoff: float, n: int, weights: Weights, meter: Accumulator | None = None) -> MetricPlan:
    """Lay the items out and say what the join would cost. ``items``: pos, is_left, is_right and the payload, stored."""
    layout = lay_out(items, space, n, weights.item_bytes)
    if not layout.rights:
        return MetricPlan(Cost(0.0, 0.0), 0.0, lambda: items.sparkSession.createDataFrame([], blocks.PAIR_SCHEMA))
    first = first_cutoff(layout, space, cutoff, shape.k, shape.two_sided)
    cost = expected_cost(layout, space, cutoff if first is None else first, weights, shape.two_sided)
    if first is not None:
        # most items are done by then; count a quarter as going on
        rest = expected_cost(layout, space, cutoff, weights, shape.two_sided)
        cost = Cost(cost.operations + rest.operations / 4, cost.moved + rest.moved / 4)
    near = expected_partners(layout, space, cutoff) * n * (1.0 if shape.two_sided else 0.5)
    return MetricPlan(cost, near, lambda: run(layout, first, space, scorer_at, shape, cutoff, meter))
