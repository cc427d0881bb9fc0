"""Every route and cutoff against all pairs by brute force, with blocks made small enough to split."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from conftest import collect_pairs
from matchloom.functions.lcs import Dense, Texts, lcs_lengths
from matchloom.operators import blocks, deletions
from matchloom.operators.fuzzy import fuzzy_join, fuzzy_scorer, fuzzy_self_join
from matchloom.operators.tfidf import tfidf_join, tfidf_self_join

SELF = {"fuzzy": fuzzy_self_join, "tfidf": tfidf_self_join}
TWO = {"fuzzy": fuzzy_join, "tfidf": tfidf_join}
BRUTE = {"fuzzy": brute.fuzzy, "tfidf": brute.tfidf}


def some_keys(n, seed):
    """Short and long keys, typos, reordered words, a hot family, and keys of spaces only."""
    rng = random.Random(seed)
    words = ["acme", "steel", "north", "trading", "gmbh", "über", "co", "x", "logistics", "und", "söhne", "no"]
    out = [" ", "  "]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.35:
            key = f"customer#{rng.randint(0, 500):06d}"
        elif kind < 0.5 and len(out) > 5:
            base = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, len(base))
                base[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "z", " "])
            key = "".join(base)
        elif kind < 0.6:
            parts = rng.choice(out).split()
            rng.shuffle(parts)
            key = "  ".join(parts)
        else:
            key = " ".join(rng.choices(words, k=rng.randint(1, 9)))
        if key and key not in out:
            out.append(key)
    rng.shuffle(out)
    return out


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK_ROWS_MIN", 8)
    monkeypatch.setattr(blocks, "CHUNK_ROWS_MAX", 17)


ROUTES = [(e, c, r) for e in ("fuzzy", "tfidf") for c, r in ((50, "bands"), (70, "bands"), (85, "bands"), (85, "signatures"), (100, "bands"))]
ROUTES += [("fuzzy", 85, "split"), ("tfidf", 60, "split"), ("fuzzy", 70, "signatures"), ("fuzzy", 51, "signatures"), ("fuzzy", 100, "signatures"), ("tfidf", 50, "signatures"), ("tfidf", 100, "signatures")]


@pytest.mark.parametrize("engine, cutoff, route", ROUTES)
def test_self_join_loses_nothing(spark, keys_of, tiny_blocks, engine, cutoff, route):
    keys = some_keys(90, cutoff)
    got = collect_pairs(SELF[engine](keys_of(keys), cutoff, 3, route))
    assert got == BRUTE[engine](keys, None, cutoff, 3)


@pytest.mark.parametrize("engine, cutoff, route", ROUTES)
def test_two_sided_join_loses_nothing(spark, keys_of, tiny_blocks, engine, cutoff, route):
    left, right = some_keys(50, cutoff), some_keys(70, cutoff + 1)
    got = collect_pairs(TWO[engine](keys_of(left), keys_of(right), cutoff, 5, route))
    assert got == BRUTE[engine](left, right, cutoff, 5)


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
@pytest.mark.parametrize("two_sided", [False, True])
def test_automatic_route(spark, keys_of, tiny_blocks, monkeypatch, engine, two_sided):
    """With no allowance for direct pairs, the counts decide; the hot family makes some signatures hot."""
    monkeypatch.setattr(blocks, "DIRECT_PAIRS", 0)
    left, right = some_keys(120, 11), some_keys(60, 12)
    if two_sided:
        got = collect_pairs(TWO[engine](keys_of(left), keys_of(right), 90, 5))
    else:
        got = collect_pairs(SELF[engine](keys_of(left), 90, 5))
    assert got == BRUTE[engine](left, right if two_sided else None, 90, 5)


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
def test_default_block_sizes(spark, keys_of, engine):
    keys = some_keys(400, 7)
    got = collect_pairs(SELF[engine](keys_of(keys), 60, 20))
    assert got == BRUTE[engine](keys, None, 60, 20)


@pytest.mark.parametrize("engine, expected", [("fuzzy", [1, 2, 3, 4, 5]), ("tfidf", [6, 5, 4, 3, 2])])
def test_ties(spark, keys_of, engine, expected):
    """Six equal partners, k = 5: the fuzzy engine keeps the earliest, TF-IDF the latest."""
    keys = ["ab cd ef"] + ["ab ef cd", "cd ab ef", "cd ef ab", "ef ab cd", "ef cd ab", "ab  cd  ef"]
    got = collect_pairs(SELF[engine](keys_of(keys), 85, 5))
    assert [b for b, _ in got[0]] == expected


def test_cutoff_is_inclusive_and_sees_unrounded_scores(spark, keys_of):
    # 17 of 20 characters shared in order: exactly 85
    exact = ["abcdefghijklmnopq123", "abcdefghijklmnopq456"]
    assert collect_pairs(fuzzy_self_join(keys_of(exact), 85, 5)) == {0: [(1, 85.0)]}
    # 2 * 113 / 266 = 84.96..., which rounds to 85.0
    below = ["a" * 113 + "b" * 20, "a" * 113 + "c" * 20]
    assert collect_pairs(fuzzy_self_join(keys_of(below), 85, 5)) == {}


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
@pytest.mark.parametrize("route", ["bands", "signatures", "split"])
def test_no_rows(spark, keys_of, engine, route):
    assert collect_pairs(SELF[engine](keys_of([]), 85, 5, route)) == {}


def test_keys_of_spaces_have_no_grams(spark, keys_of):
    assert collect_pairs(tfidf_self_join(keys_of([" ", "  "]), 85, 5)) == {}
    assert collect_pairs(fuzzy_self_join(keys_of([" ", "  "]), 85, 5)) == {0: [(1, 100.0)]}


def test_long_texts_meet_in_bands(spark, keys_of):
    rng = random.Random(2)
    base = " ".join("".join(rng.choices("abcde", k=5)) for _ in range(120))
    keys = [base, base.replace("a", "b", 9), base[:300], base[40:], base + " tail"]
    assert collect_pairs(fuzzy_self_join(keys_of(keys), 80, 5)) == brute.fuzzy(keys, None, 80, 5)
    assert collect_pairs(fuzzy_self_join(keys_of(keys), 80, 5, "signatures")) == brute.fuzzy(keys, None, 80, 5)


@pytest.mark.parametrize("two_sided", [False, True])
def test_planning(two_sided):
    """Every reachable pair of items meets in exactly one pair of chunks, and the cost counts those pairs."""
    rng = random.Random(4)
    cutoff = 80
    counts = [(band, n, rng.randint(0, n)) for band, n in ((b, rng.choice([1, 3, 9, 40])) for b in range(0, 60, 2))]

    def reach(low, high):
        return -(-low * cutoff // (200 - cutoff)), high * (200 - cutoff) // cutoff

    spans, n_chunks = blocks.band_plan([(b, n) for b, n, _ in counts], reach, 12)
    plan = {band: (first, splits, low, high) for band, first, splits, low, high in spans}
    assert max(first + splits for first, splits, _, _ in plan.values()) == n_chunks
    rows = {}
    for band, n, _ in counts:
        first, splits, low, high = plan[band]
        rows[first] = rows.get(first, 0) + (n if splits == 1 else 0)
        assert splits == -(-n // 12) if n > 12 else splits == 1
        for other, *_ in counts:
            if reach(band, band)[0] <= other <= reach(band, band)[1]:
                there, more = plan[other][:2]
                assert low <= there and there + more - 1 <= high
    assert max(rows.values()) <= 12
    expected = sum(
        (a * (m - c) if two_sided else n * m / 2)
        for band, n, a in counts
        for other, m, c in counts
        if reach(band, band)[0] <= other <= reach(band, band)[1]
    )
    assert blocks.band_cost(counts, reach, two_sided) == expected


def test_sides_are_cut_into_chunks_of_their_own():
    """A thousand left items and ten right ones of one length: ten left chunks, one right one, and nobody is sent twice."""
    counts, reach = [(18, 1010, 1000)], lambda low, high: (low, high)
    left, right, n_left, n_right = blocks.side_plans(counts, reach, 100)
    assert (left, right, n_left, n_right) == ([(18, 0, 10, 0, 0)], [(18, 0, 1, 0, 9)], 10, 1)
    assert blocks.band_moves(counts, reach, 100, True) == 1000 + 10 * 10


@pytest.mark.parametrize("lengths", [(0, 3, 18), (5, 40, 64), (0, 0, 1)])
def test_dense_lcs_equals_pair_by_pair(lengths):
    rng = random.Random(sum(lengths))
    values = ["".join(rng.choices("ab#0é漢", k=rng.choice(lengths))) for _ in range(90)] + ["common#" + str(i) for i in range(150)]
    texts = Texts(values)
    rows, cols = np.arange(0, 60), np.arange(40, len(values))
    assert Dense.fits(texts, rows)
    got = Dense(texts, rows).table(cols)
    assert (got == lcs_lengths(texts, np.tile(rows, len(cols)), np.repeat(cols, len(rows))).reshape(len(cols), -1)).all()


@pytest.mark.parametrize("high_b", [False, True])
def test_large_meetings_of_equal_scores(high_b):
    """Nearly all pairs qualify and most scores tie: all are compared at once, few are listed, positions decide."""
    rng = random.Random(3)
    left = [f"customer#{rng.randrange(3000):06d}" + "x" * rng.randrange(3) for _ in range(300)] + ["", "zzz"]
    right = [f"supplier#{rng.randrange(900):06d}" + "y" * rng.randrange(2) for _ in range(700)] + [""]
    n, k = len(left), 7
    pos = np.concatenate((np.arange(n), np.array(rng.sample(range(5000), len(right)))))
    table = pa.table({"pos": pos, "is_left": np.arange(len(pos)) < n, "is_right": np.arange(len(pos)) >= n, "form": left + right})
    shape = blocks.Shape(k=k, high_b=high_b, two_sided=True)
    counted = blocks.Groups(table, shape)
    best = blocks.Best(table, shape)
    fuzzy_scorer(55)(table, counted, best)
    best.compact()
    texts = Texts(left + right)
    i, j = np.repeat(np.arange(n), len(right)), np.tile(np.arange(n, len(pos)), n)
    total = texts.lengths[i] + texts.lengths[j]
    raw = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs_lengths(texts, i, j)) / np.maximum(total, 1)) * 100.0)
    keep = raw >= 55
    expected = blocks.best_per_item(pos[i[keep]], pos[j[keep]], raw[keep], shape)
    assert [x.tolist() for x in best.kept] == [x.tolist() for x in expected[:3]]


@pytest.mark.parametrize("k", [2, 9])
def test_deletions_lose_no_pair(spark, k):
    """Names of one length, of many lengths, with repeated forms and without characters."""
    rng = random.Random(k)
    keys = {f"customer#{rng.randrange(400):05d}" for _ in range(220)} | {"b a", "a b", "ab", "a", " ", "  ", "ac", "abc", "b  a"}
    for some in (sorted(keys), sorted(n for n in keys if n.startswith("customer"))):
        table = spark.createDataFrame([(key, 3 * pos) for pos, key in enumerate(some)], "key string, pos long")
        for cutoff in (60, 85, 97):
            by_deletions, by_bands = (collect_pairs(fuzzy_self_join(table, cutoff, k, route=route)) for route in ("deletions", "bands"))
            assert by_deletions == by_bands


def test_items_settled_by_deletions_go_no_further(spark):
    """Where all names have one length, those with k near partners are done after one exchange."""
    names = [f"customer#{i:05d}" for i in range(600)]
    items = spark.createDataFrame([(i, name, len(name)) for i, name in enumerate(names)], "pos long, form string, band long")
    shape = blocks.Shape(k=5, high_b=False, two_sided=False)
    closed, waiting, n = deletions.near_partners(items, [(14, 600, 600)], shape, 85)
    assert n == waiting.count() < 120
    assert closed.select("pos_a").distinct().count() == 600 - n
