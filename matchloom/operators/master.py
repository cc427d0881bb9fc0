"""A master side that is laid out once and mapped against many times.

The master's keys are stored as a table bucketed by block, a part of a leaf of the metric tree (see ``metric``) with a
bounded number of keys, beside a small table with the pivots, the planes and the boxes. Mapping a primary table reads
its keys once, sends each to the blocks that its point may reach, and meets the stored blocks where they are: only the
primary side moves. A block with many visitors is met in several passes, so that a group stays bounded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import blocks, metric
from matchloom.operators.blocks import Shape
from matchloom.operators.fuzzy import INDEL, fuzzy_scorer, sorted_forms, top_k_fuzzy
from matchloom.plans.scratch import materialise_counted, scratch_path

_COLUMNS = "block long, pos long, form string, reach_size long, point binary"
_BUCKET_BYTES = 64 << 20


@dataclass(frozen=True)
class MasterIndex:
    """``blocks``: for each leaf its number of blocks. ``table`` is known to the session that made or loaded it."""

    table: str
    tree: metric.Tree
    pivots: pa.Table
    blocks: dict[int, int]


def _most(avg_bytes: float) -> int:
    return max(1, min(blocks.CHUNK_ROWS_MAX, int(blocks.CHUNK_BYTES / max(avg_bytes, 1.0))))


def _placer(tree: metric.Tree, parts: dict[int, int]):
    """Each key in its one block."""

    def run(batches):
        for batch in batches:
            pos, home = batch["pos"].to_numpy(), tree.home(metric.points_of(batch["point"]))
            block = np.zeros(len(pos), np.int64)
            for leaf in np.unique(home):
                rows = np.flatnonzero(home == leaf)
                block[rows] = (int(leaf) << 32) + metric.dealt(pos[rows], parts[int(leaf)])
            arrays = [pa.array(block), *(batch[c] for c in ("pos", "form", "reach_size", "point"))]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "pos", "form", "reach_size", "point"])

    return run


def build_master_index(master: DataFrame, folder: str | None = None) -> MasterIndex:
    """Lay out ``key, pos`` rows. With a folder, the index can be loaded by other sessions; without, it is scratch."""
    spark = master.sparkSession
    folder = folder or scratch_path(spark, "master-index")
    sides = sorted_forms(master).select("pos", "form", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    items, seen = materialise_counted(sides, "master-forms", n=F.count(F.lit(1)), chars=F.sum(F.length("form")))
    n, avg = seen["n"], 4.0 * (seen["chars"] or 0) / max(seen["n"], 1) + 64
    layout = metric.lay_out(items, INDEL, n, avg)
    parts = {leaf: -(-held // _most(avg)) for leaf, held in layout.rights.items()}
    buckets = max(1, min(max(sum(parts.values()), 1), max(int(n * avg / _BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if layout.rights:
        placed = layout.items.mapInArrow(_placer(layout.tree, parts), _COLUMNS)
    else:
        placed = spark.createDataFrame([], _COLUMNS)
    name = _name()
    placed.repartition(buckets, "block").write.option("path", f"{folder}/blocks").bucketBy(buckets, "block").saveAsTable(name)
    meta = {
        "buckets": buckets,
        "pivots": layout.pivots["form"].to_pylist() if layout.rights else [],
        "planes": [layout.tree.place, layout.tree.cut, layout.tree.left, layout.tree.right, layout.tree.leaf, layout.tree.leaves],
        "boxes": [[leaf, low.tolist(), high.tolist(), int(size), parts[leaf]] for leaf, (low, high, size) in layout.boxes.items()],
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{folder}/meta")
    return _index(name, meta)


def load_master_index(spark: SparkSession, folder: str) -> MasterIndex:
    """Make a stored index known to this session."""
    meta = json.loads(spark.read.schema("meta string").parquet(f"{folder}/meta").first()["meta"])
    name = _name()
    place = f"{folder}/blocks".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (block) INTO {int(meta['buckets'])} BUCKETS LOCATION '{place}'")
    return _index(name, meta)


def _name() -> str:
    return f"master_{uuid.uuid4().hex}"


def _index(name: str, meta: dict) -> MasterIndex:
    tree = metric.Tree(np.empty((0, 1), np.float32), 1)
    tree.place, tree.cut, tree.left, tree.right, tree.leaf, tree.leaves = meta["planes"]
    boxes = {leaf: (np.array(low, np.float32), np.array(high, np.float32), size) for leaf, low, high, size, _ in meta["boxes"]}
    tree.fill(boxes)
    return MasterIndex(name, tree, pa.table({"form": pa.array(meta["pivots"], pa.string())}), {leaf: parts for leaf, *_, parts in meta["boxes"]})


def _visitor(index: MasterIndex, slope: float, flat: float):
    """A key in every block that it may reach."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = batch["reach_size"].to_numpy()
            rows, block = [], []
            for leaf, some in index.tree.visits(metric.points_of(batch["point"]), sizes, slope, flat):
                for part in range(index.blocks[leaf]):
                    rows.append(some)
                    block.append(np.full(len(some), (leaf << 32) + part))
            if rows:
                taken = table.select(["pos", "form", "reach_size", "point"]).take(pa.array(np.concatenate(rows)))
                out = pa.Table.from_arrays([pa.array(np.concatenate(block)), *taken.columns], names=["block", *taken.column_names])
                yield from out.to_batches()

    return run


def _meet(cutoff: int, shape: Shape):
    score = metric.score_block(fuzzy_scorer(cutoff), shape, INDEL, cutoff, None)
    schema = pa.schema([("pos", pa.int64()), ("form", pa.string()), ("reach_size", pa.int64()), ("point", pa.binary())])

    def run(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        sides = [t.select(schema.names).cast(schema) for t in (lefts, rights)]
        left = np.repeat([True, False], [t.num_rows for t in sides])
        return score(pa.concat_tables(sides).append_column("is_left", pa.array(left)).append_column("is_right", pa.array(~left)))

    return run


def map_to_index(primary: DataFrame, index: MasterIndex, cutoff: int = 85, k: int = 5) -> DataFrame:
    """``pos_a, pos_b, raw, rank``, as ``fuzzy_join`` gives them; the master does not move."""
    spark = primary.sparkSession
    if not index.blocks:
        return top_k_fuzzy(spark.createDataFrame([], blocks.PAIR_SCHEMA), k)
    forms = sorted_forms(primary)
    pointed = forms.mapInArrow(metric.pointer(INDEL, index.pivots), "pos long, form string, reach_size long, point binary")
    items, seen = materialise_counted(pointed, "primary-points", chars=F.avg("reach_size"))
    slope, flat = (float(x) for x in INDEL.allowed(np.float64(cutoff)))
    visiting = items.mapInArrow(_visitor(index, slope, flat + metric.SLACK), _COLUMNS)
    fullest = visiting.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    passes = max(1, -(-fullest // _most(4.0 * (seen["chars"] or 0) + 64)))
    stored = spark.table(index.table).groupBy("block")
    meet = _meet(cutoff, Shape(k=k, high_b=False, two_sided=True))
    turn = F.pmod(F.xxhash64("pos"), F.lit(passes))
    found = [visiting.filter(turn == i).groupBy("block").cogroup(stored).applyInArrow(meet, blocks.PAIR_SCHEMA) for i in range(passes)]
    return top_k_fuzzy(reduce(DataFrame.unionAll, found), k)
