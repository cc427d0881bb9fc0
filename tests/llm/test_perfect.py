"""Exact dedup: the perfect hash itself, and every decision against a plain dictionary."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import perfect

SCHEMA = "doc_id long, text string, lang string"
ROWS = [
    (5, "same", "en"),
    (9, "same", "de"),
    (9, "same", "de"),
    (None, "same", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, "Same", "en"),
    (4, "same ", "en"),
    (None, "nobody", None),
    (None, "nobody", "en"),
    (7, "x" * 300_000, "en"),
    (8, "x" * 300_000, "en"),
    (9, "other text of a repeated id", "en"),
]


def brute(rows):
    groups = {}
    for ident, text, *_ in rows:
        groups.setdefault(text or "", []).append(ident)
    out = []
    for ident, text, *_ in rows:
        ids = groups[text or ""]
        best = max((i for i in ids if i is not None), default=None)
        out.append((ident, best, len(ids), ident is not None and ident == best, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
    levels, slots = perfect.perfect_hash(keys)
    assert sorted(slots) == list(range(n))
    assert np.array_equal(perfect.slots_of(keys, levels), slots)
    strangers = perfect.slots_of(rng.integers(0, 2**63, (500, 4), dtype=np.uint64), levels)
    assert ((strangers >= -1) & (strangers < max(n, 1))).all()


def test_against_a_dictionary(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert rows_of(perfect.report(docs)) == brute(ROWS)
    assert perfect.report(docs.limit(0)).count() == 0
    rng = random.Random(3)
    many = [(rng.choice([None, *range(1000)]), f"text {int(rng.random() ** 3 * 400)}", "en") for _ in range(3000)]
    assert rows_of(perfect.report(spark.createDataFrame(many, SCHEMA).repartition(7))) == brute(many)


def test_all_old_all_new_and_hot(spark):
    for rows in ([(4, "a", ""), (4, "b", ""), (4, "a", "")], [(None, "a", ""), (None, "a", "")], [(i, "hot" if i % 3 else str(i), "") for i in range(4000)]):
        assert rows_of(perfect.report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_history_and_batches(spark, tmp_path):
    old = [(1, "a", ""), (2, "b", ""), (3, "b", "")]
    new = [(9, "a", ""), (10, "c", ""), (11, "c", ""), (0, "b", "")]
    tables = [perfect.copies_of(perfect.digests(spark.createDataFrame(rows, SCHEMA))) for rows in (old, new)]
    index = perfect.build_index(*tables[0], path=f"{tmp_path}/index")
    assert index.distinct == 2
    again = perfect.load_index(spark, f"{tmp_path}/index", index.buckets, index.distinct)
    got = {(r["digest"], r["keep_id"], r["group_size"], r["member"]) for r in perfect.look_up(again, tables[1][0]).collect()}
    want = {("a", 9, 2, True), ("b", 3, 3, True), ("c", 11, 2, False)}
    assert {(bytes(d), *rest) for d, *rest in got} == {(hashlib.sha256(t.encode()).digest(), *rest) for t, *rest in want}


def test_rows_that_stay(spark):
    wide = spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(0).alias(c) for c in ("id", "digest", "id_", "digest_", "times_", "keep_id", "bucket", "winner")])
    out = perfect.drop_copies(wide)
    assert out.columns == wide.columns
    kept = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in out.collect()), key=str)
    want = [(2, ""), (3, "Same"), (4, "same "), (8, "x" * 9), (9, "other tex"), (9, "same"), (None, "nobody")]
    assert kept == sorted(want, key=str)
    assert perfect.drop_copies(wide.limit(0)).count() == 0
