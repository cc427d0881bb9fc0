"""Mapping against a stored master: equal to comparing all pairs, and the master stays where it is."""

import pytest

import brute
from conftest import collect_pairs
from matchloom.operators import blocks, metric
from matchloom.operators.master import build_master_index, load_master_index, map_to_index
from test_joins import some_keys


@pytest.mark.parametrize("cutoff", [51, 70, 85, 100])
def test_against_all_pairs(spark, keys_of, monkeypatch, cutoff):
    monkeypatch.setattr(blocks, "CHUNK_ROWS_MAX", 9)
    monkeypatch.setattr(metric, "LEAF_ROWS", 6)
    left, right = some_keys(60, cutoff), some_keys(90, cutoff + 1)
    index = build_master_index(keys_of(right))
    assert collect_pairs(map_to_index(keys_of(left), index, cutoff, 5)) == brute.fuzzy(left, right, cutoff, 5)


def test_second_mapping_moves_only_the_primary(spark, keys_of, tmp_path):
    right = some_keys(300, 4)
    build_master_index(keys_of(right), f"{tmp_path}/index")
    index = load_master_index(spark, f"{tmp_path}/index")
    for seed in (5, 6):
        left = some_keys(40, seed)
        got = map_to_index(keys_of(left), index, 80, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # the one exchange by block is that of the primary; the master is read as it is stored
        assert plan.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in plan
        assert collect_pairs(got) == brute.fuzzy(left, right, 80, 3)


def test_nothing_to_map(spark, keys_of):
    some = keys_of(some_keys(20, 1))
    assert collect_pairs(map_to_index(some, build_master_index(keys_of([])), 85, 5)) == {}
    assert collect_pairs(map_to_index(keys_of([]), build_master_index(some), 85, 5)) == {}
