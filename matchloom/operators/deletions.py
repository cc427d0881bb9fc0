"""Nearest partners of short texts through what is left when one character is deleted.

Two texts have a common subsequence of all but at most one character of each exactly if they are equal, or become
equal, when at most one character is deleted from each. So all texts meet under themselves and their deletions, and
the length of what they share there is known without comparing them. What such meetings cannot find scores at most
``best_missed``; an item whose k-th partner scores more needs no other search.

A meeting is as large as the number of texts that differ from its text by one inserted character, times the orders of
words that lead to one sorted form: alphabet and length bound it, not the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.lcs import flat_ranges
from matchloom.operators import blocks
from matchloom.operators.blocks import Shape
from matchloom.plans.scratch import materialise

#: Rows of a block, on average.
_BLOCK_ROWS = 1 << 16
#: Share of items that may stay open; with more, another plan takes all of them.
OPEN_SHARE = 0.1


def best_missed(lengths: list[int]) -> dict[int, float]:
    """For each length that occurs, the best score of a pair that loses two characters or more on one side."""
    lengths = sorted(lengths)
    out = {}
    for n in lengths:
        at, to = bisect_right(lengths, n - 2) - 1, bisect_left(lengths, n + 2)
        near = [m for m in (n - 1, n, n + 1) if lengths[bisect_left(lengths, m) : bisect_right(lengths, m)]]
        others = near + ([lengths[at]] if at >= 0 else []) + ([lengths[to]] if to < len(lengths) else [])
        lost = {m: (4, 3)[abs(m - n)] if abs(m - n) < 2 else abs(m - n) for m in others}
        out[n] = max(100.0 * (1.0 - min(lost[m], n + m) / (n + m)) if n + m else -1.0 for m in others)
    return out


def settles(counts: list[tuple[int, int, int]], cutoff: float) -> float:
    """Share of items for which partners that differ in one character are better than all that may be missed."""
    missed = best_missed([band for band, _, _ in counts])
    good = sum(n for band, n, _ in counts if missed[band] < max(cutoff, 100.0 * (1.0 - 1.0 / max(band, 1))))
    return good / max(sum(n for _, n, _ in counts), 1)


def _deleted(items: DataFrame) -> DataFrame:
    """``pos, left, cut``: each text, and what is left of it without one character."""
    items = items.filter("pos is not null")
    form, n = F.col("form"), F.length("form")
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(form, F.lit(1), i - 1), F.substr(form, i + 1)))
    whole = items.select("pos", form.alias("left"), F.lit(0).alias("cut"))
    return whole.unionAll(items.filter(n > 0).select("pos", F.explode(F.array_distinct(without)).alias("left"), F.lit(1).alias("cut")))


def _meet(shape: Shape, cutoff: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        left = pc.dictionary_encode(table["left"].combine_chunks())
        shared = pc.utf8_length(left.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        # several texts may have one position
        row = np.unique(np.column_stack((left.indices.to_numpy(), table["pos"].to_numpy(), table["cut"].to_numpy())), axis=0)
        sig, pos, cut = row.T
        last = np.flatnonzero(np.append(np.diff(sig) != 0, True))
        end = np.repeat(last + 1, np.diff(np.append(-1, last)))
        turn = np.flatnonzero(np.append((np.diff(sig) != 0) | (np.diff(pos) != 0), True))
        after = np.repeat(turn + 1, np.diff(np.append(-1, turn)))
        found = []
        for other in (0, 1):
            some = np.flatnonzero(cut == other)
            first = np.searchsorted(some, after)
            sizes = np.minimum(np.searchsorted(some, end) - first, shape.k)
            i, j = np.repeat(np.arange(len(row)), sizes), some[flat_ranges(first, sizes)]
            lcs = shared[sig[i]]
            total = 2 * lcs + cut[i] + other
            near = 200 * lcs >= cutoff * total
            i, j, lcs, total = i[near], j[near], lcs[near], total[near]
            with np.errstate(invalid="ignore", divide="ignore"):
                raw = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / total) * 100.0)
            found.append((pos[i], pos[j], raw))
        a, b, raw, _ = blocks.best_per_item(*(np.concatenate(c) for c in zip(*found)), shape)
        return pa.table({"pos_a": a, "pos_b": b, "raw": raw})

    return run


def near_partners(items: DataFrame, counts: list[tuple[int, int, int]], shape: Shape, cutoff: float) -> tuple[DataFrame, DataFrame, int]:
    """``pos_a, pos_b, raw`` of the items that are done, the positions that are not, and their number.

    ``items``: pos, form and band (the length) of one table whose pairs count once, with ties to the earlier partner.
    """
    rows = sum((band + 1) * n for band, n, _ in counts)
    n_blocks = rows // _BLOCK_ROWS + 1
    met = _deleted(items).withColumn("block", F.pmod(F.xxhash64("left"), F.lit(n_blocks)))
    spread = met.repartition(blocks._partition_count(items, n_blocks), "block")
    found = spread.groupBy("block").applyInArrow(_meet(shape, cutoff), blocks.PAIR_SCHEMA)
    ranked = materialise(blocks.keep_top_k(found, shape.k, shape.high_b), "near-partners")
    missed = items.sparkSession.createDataFrame(list(best_missed([band for band, _, _ in counts]).items()), "band long, missed double")
    asked = items.join(F.broadcast(missed), "band").groupBy("pos").agg(F.max("missed").alias("missed"))
    reached = ranked.filter(F.col("rank") == shape.k).select(F.col("pos_a").alias("pos"), F.col("raw").alias("reached"))
    done = (F.col("missed") < cutoff - 1e-9) | F.coalesce(F.col("reached") > F.col("missed") + 1e-9, F.lit(False))
    open_items = materialise(asked.join(reached, "pos", "left").filter(~done).select("pos"), "open-items")
    closed = ranked.join(open_items, F.col("pos_a") == F.col("pos"), "left_anti").select("pos_a", "pos_b", "raw")
    return closed, open_items, open_items.count()
