"""Whole results where an operator once did less."""

import itertools
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm import decontam, lines, xent


def test_recall_of_near_lines(spark):
    """Of all pairs with an edit similarity of 0.9, whatever their SimHashes, nearly all are in one group."""
    random.seed(11)
    words = ["".join(random.choice("aeioubdfgklmnprst") for _ in range(random.randrange(3, 9))) for _ in range(800)]
    rows, near = [], 0
    for i in range(200):
        line = random.choices(words, k=random.choice((10, 20, 50)))
        changed = list(line)
        at = random.randrange(len(line))
        changed[at] = changed[at][:-1] + "x"
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(changed))]
    con = duckdb.connect()
    for (_, x), (_, y) in zip(rows[::2], rows[1::2]):
        near += con.execute("SELECT levenshtein(?, ?) * 10 <= greatest(length(?), length(?))", [x, y, x, y]).fetchone()[0]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))[0].agg(F.sum("lines_removed")).first()[0]
    assert near == 200 and 0.85 * near <= got <= near


@pytest.mark.parametrize("classes", [100, 1 << 20, 1 << 26])
def test_near_lines_meet_once(spark, classes):
    """All pairs within the sure bits meet, and each pair meets once, however fine the blocks are."""
    random.seed(12)
    sims = [random.getrandbits(63) for _ in range(40)]
    sims += [s ^ sum(1 << b for b in random.sample(range(63), k)) for s in sims for k in (1, 4, 6, 9, 12)]
    rows = spark.createDataFrame([(i, s, 100, i) for i, s in enumerate(sims)], "cid long, sim long, len int, component long")
    blocks, extra = lines.cut_blocks(classes, lines.SURE)
    got = [tuple(r) for r in lines.near_pairs(rows, blocks, extra, lines.BITS, 90).collect()]
    far = {(i, j): (sims[i] ^ sims[j]).bit_count() for i, j in itertools.combinations(range(len(sims)), 2)}
    assert len(got) == len(set(got)) and all(far[p] <= lines.BITS for p in got)
    assert {p for p, d in far.items() if d <= lines.SURE} <= set(got)


def test_short_lines_by_equality(spark):
    chinese = "这是一行没有标点的很长的中文文本它在语料库中重复出现了很多次"
    rows = [(1, f"Read more\n{chinese}\n---"), (2, f"read more!\nother\n{chinese}\n---"), (3, "Read some")]
    kept = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))[0]
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == [(1, f"Read more\n{chinese}\n---"), (2, "other\n---"), (3, "Read some")]


def test_items_without_id_are_hits(spark):
    passage = " ".join(f"word{chr(97 + i)}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "quite other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, passage)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.report(docs, bench).collect()}
    assert got == {1: (12, 0, True), 2: (0, 0, False)}
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()] == [2]


def test_losses_of_exact_counts(spark):
    """More words than the 2**18 places that once held all counts."""
    random.seed(13)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(7000)) + " the end the end") for i in range(40)] + [(40, "the end"), (40, "the end"), (41, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    words, pairs, before = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for i, text in rows:
        w = (text or "").split()
        for side in [1] + [0] * (i < 10):
            words[side].update(w)
            pairs[side].update(zip([None, *w], w))
            before[side].update([None, *w][: len(w)])
    size, totals = len(words[1]) + 1, [words[side].total() for side in (0, 1)]
    assert size > 1 << 18
    got = [r for r in xent.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels).collect()]
    assert len(got) == len(rows)
    for r in got:
        w, want = (dict(rows)[r["doc_id"]] or "").split(), []
        for side, scale in ((0, 1.0), (1, totals[0] / totals[1])):
            p_word = {x: (words[side][x] * scale + 0.5) / (totals[side] * scale + 0.5 * size) for x in w}
            p = [(pairs[side][a, x] * scale + 4 * p_word[x]) / (before[side][a] * scale + 4) for a, x in zip([None, *w], w)]
            want.append(-sum(map(math.log, p)) / max(1, len(w)))
        assert r["n_tokens"] == len(w) and math.isclose(r["target_loss"], want[0], abs_tol=1e-9) and math.isclose(r["background_loss"], want[1], abs_tol=1e-9)
