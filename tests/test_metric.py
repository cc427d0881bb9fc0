"""Joins through pivots: nothing is lost on any path, and few pairs are looked at."""

import os

import numpy as np
import pyarrow as pa
import pytest

import brute
from conftest import collect_pairs
from matchloom.operators import blocks, fuzzy, keys, metric, tfidf
from matchloom.plans.registered import PART_COLS, part_keys, table
from test_joins import BRUTE, SELF, TWO, some_keys

SF = "/root/testdata/sf0.01"
CASES = [("fuzzy", c) for c in (50, 51, 70, 85, 100)] + [("tfidf", c) for c in (50, 85, 100)]


@pytest.fixture
def tiny(monkeypatch):
    """Few pivots, small leaves from a sample of the points, and tiles."""
    monkeypatch.setattr(blocks, "CHUNK_ROWS_MAX", 7)
    for name, value in (("PIVOTS", 4), ("LEAF_ROWS", 6), ("SAMPLE_POINTS", 40), ("SAMPLE_ROWS", 30)):
        monkeypatch.setattr(metric, name, value)


@pytest.mark.parametrize("engine, cutoff", CASES)
def test_loses_nothing(spark, keys_of, tiny, engine, cutoff):
    left, right = some_keys(90, cutoff), some_keys(60, cutoff + 1)
    assert collect_pairs(SELF[engine](keys_of(left), cutoff, 3, "metric")) == BRUTE[engine](left, None, cutoff, 3)
    assert collect_pairs(TWO[engine](keys_of(left), keys_of(right), cutoff, 5, "metric")) == BRUTE[engine](left, right, cutoff, 5)


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
def test_whole_size(spark, keys_of, engine):
    many = some_keys(400, 7)
    assert collect_pairs(SELF[engine](keys_of(many), 70, 20, "metric")) == BRUTE[engine](many, None, 70, 20)


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
@pytest.mark.parametrize("two_sided", [False, True])
def test_two_rounds(spark, keys_of, tiny, monkeypatch, engine, two_sided):
    """A family of alike names: most find k partners at a higher cutoff, the last ones and strangers go on."""
    rounds = []
    one = metric.one_round
    monkeypatch.setattr(metric, "one_round", lambda layout, lefts, *rest: rounds.append(lefts is not None) or one(layout, lefts, *rest))
    names = [f"customer number {i:04d} of the northern trading company" for i in range(0, 900, 4)] + some_keys(30, 5)
    other = [f"customer number {i:04d} of the northern trading company" for i in range(1, 900, 9)] + some_keys(20, 6)
    if two_sided:
        got, want = TWO[engine](keys_of(names), keys_of(other), 60, 2, "metric"), BRUTE[engine](names, other, 60, 2)
    else:
        got, want = SELF[engine](keys_of(names), 60, 2, "metric"), BRUTE[engine](names, None, 60, 2)
    assert collect_pairs(got) == want
    assert rounds == [False, True]


def test_empty_and_alike(spark, keys_of):
    for engine in ("fuzzy", "tfidf"):
        assert collect_pairs(SELF[engine](keys_of([]), 85, 5, "metric")) == {}
        assert collect_pairs(TWO[engine](keys_of(["a b"]), keys_of([]), 85, 5, "metric")) == {}
    same = ["ab cd ef", "ab ef cd", "cd ab ef", "cd ef ab", "ef ab cd", "ef cd ab", "ab  cd  ef"]
    assert [b for b, _ in collect_pairs(fuzzy.fuzzy_self_join(keys_of(same), 85, 5, "metric"))[0]] == [1, 2, 3, 4, 5]
    assert [b for b, _ in collect_pairs(tfidf.tfidf_self_join(keys_of(same), 85, 5, "metric"))[0]] == [6, 5, 4, 3, 2]


def test_distances_are_metric():
    rng = np.random.default_rng(2)
    forms = pa.table({"form": ["".join(rng.choice(list("abc "), rng.integers(0, 12))) for _ in range(40)]})
    d = fuzzy.INDEL.measure(forms, forms)
    assert (d == d.T).all() and (np.diag(d) == 0).all()
    assert (d[:, None, :] <= d[:, :, None] + d[None, :, :]).all()
    assert all(d[i, j] == len(a) + len(b) - 2 * brute.lcs(a, b) for i, a in enumerate(forms["form"].to_pylist()) for j, b in enumerate(forms["form"].to_pylist()))


def test_visits_reach_every_near_point():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 30, (500, 6)).astype(np.float32)
    sizes = rng.integers(0, 20, 500)
    tree = metric.Tree(points[:60], 4)
    home = tree.home(points)
    tree.fill({leaf: (points[home == leaf].min(axis=0), points[home == leaf].max(axis=0), int(sizes[home == leaf].max())) for leaf in np.unique(home)})
    visited = {(i, leaf) for leaf, rows in tree.visits(points, sizes, 0.1, 2.0) for i in rows}
    gap = np.abs(points[:, None, :] - points[None, :, :]).max(axis=2)
    near = np.argwhere(gap <= 0.1 * (sizes[:, None] + sizes[None, :]) + 2.0)
    assert all((i, home[j]) in visited for i, j in near) and len(visited) < 500 * tree.leaves


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_few_pairs_are_looked_at(spark):
    """At 85 one pair in fifty of the parts is scored; of the customers, 44 % of whose pairs qualify, one in seven."""
    customers = keys.distinct_keys(keys.keyed(table(spark, SF, "customer"), ("c_name",), "c_custkey"))
    for some, k, share in ((part_keys(spark, SF, (*PART_COLS, "p_type")), 5, 1 / 50), (customers, 20, 1 / 7)):
        meter = spark.sparkContext.accumulator(0)
        n = some.count()
        got = collect_pairs(fuzzy.fuzzy_self_join(some, 85, k, "metric", meter))
        assert 0 < meter.value < n * (n - 1) / 2 * share
        assert got == collect_pairs(fuzzy.fuzzy_self_join(some, 85, k, "bands"))


def test_automatic_choice(spark, keys_of, monkeypatch):
    """With no allowance for direct work, the expected cost decides, and both choices give the same pairs."""
    monkeypatch.setattr(blocks, "DIRECT_SECONDS", 0.0)
    many = some_keys(300, 9)
    ran = []
    one, bands = metric.one_round, blocks.by_bands
    monkeypatch.setattr(metric, "one_round", lambda *a: ran.append("metric") or one(*a))
    monkeypatch.setattr(blocks, "by_bands", lambda *a: ran.append("bands") or bands(*a))
    want = brute.fuzzy(many, None, 90, 3)
    assert collect_pairs(fuzzy.fuzzy_self_join(keys_of(many), 90, 3)) == want
    plan = metric.plan

    def cheap(*args, **more):
        made = plan(*args, **more)
        return blocks.MetricPlan(blocks.Cost(0.0, 0.0), made.near_pairs, made.run)

    monkeypatch.setattr(metric, "plan", cheap)
    assert collect_pairs(fuzzy.fuzzy_self_join(keys_of(many), 90, 3)) == want
    assert ran[-1] == "metric"
