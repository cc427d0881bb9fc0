"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

The history's distinct digests (SHA-256 of the whole text) are dealt to buckets of some thousand. Each bucket gets a
minimal perfect hash: levels of bit arrays in which a digest that is alone at its place sets the bit, the rank of the
bit is its slot, and digests that collide go on to the next level. A slot holds the full digest, the winner's id and
the number of copies. A batch is looked up in its bucket: the hash sends any digest to some slot, and only if all 32
bytes there are equal is it a repeat; nonmembers are grouped by themselves and can be added as new slots.

Of equal texts the row with the largest id stays. Defined results:

* a null text counts as an empty one; texts are compared as they are, with no change;
* rows without an id never win, unless no copy has one: then ``keep_id`` is null and none of them is kept by ``report``;
* rows that repeat both id and text all count; ``report`` marks each of them kept, ``drop_copies`` leaves one;
* rows that share an id but not the text are judged by their texts; an empty table gives an empty result;
* other columns, whatever their names, are carried by ``drop_copies`` and ignored by ``report``.

Copies are summed before they move, so a text that a third of all rows share is one row for each task. Buckets have
a bounded number of distinct digests. Only digests with more than a thousandth of all rows are broadcast: fewer
than a thousand of them can exist.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.tables import col, fresh
from matchloom.llm.words import mix
from matchloom.plans.scratch import materialise, materialise_counted

#: Distinct digests of a bucket, on average.
BUCKET = 1024
#: Places for each digest on a level.
_SPREAD = 2
#: A digest is hot with more than one row in so many.
_HOT = 1000
_INDEX = "bucket int, places array<int>, bits binary, digests binary, winners binary, known binary, copies binary"
_FOUND = "digest binary, keep_id long, group_size long, member boolean"
_GOLDEN = 0x9E3779B97F4A7C15


# --- the hash of one bucket -------------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
    """Where each digest (four 64-bit words) falls on a level."""
    step = np.uint64((_GOLDEN * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix(keys[:, level % 4] + mix(keys[:, (level + 1) % 4] + step)) % np.uint64(places)


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each of the distinct keys: every slot below their number once."""
    slots = np.zeros(len(keys), np.int64)
    levels: list[np.ndarray] = []
    rest, base = np.arange(len(keys)), 0
    while len(rest):
        places = _SPREAD * len(rest)
        at = _place(keys[rest], len(levels), places)
        alone = np.bincount(at.astype(np.int64), minlength=places) == 1
        done = alone[at]
        slots[rest[done]] = base + np.cumsum(alone)[at[done]] - 1
        base += int(alone.sum())
        levels.append(alone)
        rest = rest[~done]
    return levels, slots


def slots_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot to which the hash sends each key, member or not; -1 if no level takes it."""
    slots = np.full(len(keys), -1, np.int64)
    rest, base = np.arange(len(keys)), 0
    for level, alone in enumerate(levels):
        if not len(rest):
            break
        at = _place(keys[rest], level, len(alone))
        hit = alone[at]
        slots[rest[hit]] = base + np.cumsum(alone)[at[hit]] - 1
        base += int(alone.sum())
        rest = rest[~hit]
    return slots


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(bytearray().join(digests.to_pylist()), np.uint64).reshape(-1, 4) if len(digests) else np.empty((0, 4), np.uint64)


def _build(table: pa.Table) -> pa.Table:
    keys = _words(table["digest"])
    levels, slots = perfect_hash(keys)
    order = np.argsort(slots)
    winners = table["winner"].fill_null(0).to_numpy()[order]
    known = table["winner"].is_valid().to_numpy(zero_copy_only=False)[order]
    row = {
        "bucket": table["bucket"][0].as_py(),
        "places": [len(a) for a in levels],
        "bits": np.packbits(np.concatenate(levels)).tobytes(),
        "digests": keys[order].tobytes(),
        "winners": winners.tobytes(),
        "known": known.tobytes(),
        "copies": table["copies"].to_numpy()[order].tobytes(),
    }
    types = [pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.table({name: pa.array([row[name]], kind) for name, kind in zip(row, types)})


def _look_up(index: pa.Table, batch: pa.Table) -> pa.Table:
    """Every slot with what the batch adds to it, then the nonmembers."""
    keys, winner, copies = np.empty((0, 4), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    known, levels = np.empty(0, bool), []
    if index.num_rows:
        row = {name: index[name][0].as_py() for name in index.column_names}
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["places"])].astype(bool)
        levels = np.split(bits, np.cumsum(row["places"])[:-1])
        keys = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        winner, copies = (np.frombuffer(row[name], np.int64).copy() for name in ("winners", "copies"))
        known = np.frombuffer(row["known"], bool).copy()
    asked = _words(batch["digest"])
    new, more = batch["winner"].fill_null(0).to_numpy(), batch["copies"].to_numpy()
    has_id = batch["winner"].is_valid().to_numpy(zero_copy_only=False)
    slot = slots_of(asked, levels)
    member = slot >= 0
    member[member] = (keys[slot[member]] == asked[member]).all(axis=1)
    at = slot[member]
    copies[at] += more[member]
    newer = has_id[member] & (~known[at] | (new[member] > winner[at]))
    winner[at[newer]] = new[member][newer]
    known[at[newer]] = True
    digests = np.concatenate((keys, asked[~member]))
    ids = pa.array(np.concatenate((winner, new[~member])), mask=~np.concatenate((known, has_id[~member])))
    return pa.table(
        {
            "digest": pa.array([d.tobytes() for d in digests], pa.binary()),
            "keep_id": ids,
            "group_size": np.concatenate((copies, more[~member])),
            "member": np.arange(len(digests)) < len(keys),
        }
    )


# --- tables -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """One row per bucket; ``buckets`` is their number, ``distinct`` the number of slots."""

    table: DataFrame
    buckets: int
    distinct: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` of every row: 32 bytes for each text."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def copies_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """``digest, winner, copies``, stored, and the number of distinct digests."""
    grouped = rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    stored, seen = materialise_counted(grouped, "copies", n=F.count(F.lit(1)))
    return stored, seen["n"]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def build_index(history: DataFrame, distinct: int, expected: int = 0, path: str | None = None) -> Index:
    """Hash the history's ``digest, winner, copies``. ``expected``: distinct digests of the largest batch to come."""
    buckets = max(1, max(distinct, expected) // BUCKET)
    table = history.select("*", _bucket(buckets)).groupBy("bucket").applyInArrow(_build, _INDEX)
    if path is None:
        return Index(materialise(table, "perfect-hash"), buckets, distinct)
    table.write.parquet(path)
    return load_index(history.sparkSession, path, buckets, distinct)


def load_index(spark: SparkSession, path: str, buckets: int, distinct: int) -> Index:
    return Index(spark.read.schema(_INDEX).parquet(path), buckets, distinct)


def look_up(index: Index, batch: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size, member`` of the history and a batch (``digest, winner, copies``) together.

    ``member`` tells the history's digests, updated by the batch's repeats, from the batch's new ones.
    """
    asked = batch.select("*", _bucket(index.buckets)).groupBy("bucket")
    return index.table.groupBy("bucket").cogroup(asked).applyInArrow(_look_up, _FOUND)


def decisions(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``groups`` (one row per digest) joined to all ``id, digest`` rows; no digest is a long join key."""
    hot = F.col("group_size") * _HOT > total
    few = F.broadcast(groups.filter(hot))
    mine = rows.join(few, "digest")
    rest = rows.join(few.select("digest"), "digest", "left_anti").join(groups.filter(~hot), "digest")
    return mine.unionAll(rest)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, keep_id, group_size`` of every row.

    The lower half of the range of ids is the history, the other rows (also those without an id) are the batch.
    """
    low, high, n = F.min("id"), F.max("id"), F.count(F.lit(1))
    rows, seen = materialise_counted(digests(docs, id_col, text_col), "digests", low=low, high=high, n=n)
    middle = ((seen["low"] or 0) + (seen["high"] or 0)) // 2
    old = F.coalesce(F.col("id") <= middle, F.lit(False))
    history, n_old = copies_of(rows.filter(old))
    batch, n_new = copies_of(rows.filter(~old))
    index = build_index(history, n_old, n_new)
    groups = materialise(look_up(index, batch).drop("member"), "equal-texts")
    return decisions(rows, groups, seen["n"])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, dropped ones too."""
    return judged(docs).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of copies without any id one stays."""
    winners = judged(docs, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    winners = winners.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    ident, digest, times = fresh(docs.columns, "id_", "digest_", "times_")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn(digest, F.unhex(F.sha2(text, 256))).withColumn(ident, col(id_col).cast("long"))
    wanted = winners.select(F.col("id").alias("w_id"), F.col("digest").alias("w_digest"), F.col("times").alias(times))
    same = (F.col(digest) == wanted["w_digest"]) & F.col(ident).eqNullSafe(wanted["w_id"])
    found = marked.join(wanted, same).drop("w_id", "w_digest")
    once = found.filter(F.col(times) == 1).unionAll(found.filter(F.col(times) > 1).dropDuplicates([ident, digest]))
    return once.drop(ident, digest, times)
