import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import matchloom.functions.lcs as lcs_module
from matchloom.functions.lcs import Texts, lcs_lengths
from matchloom.operators import fuzzy, tfidf
from matchloom.operators.blocks import Shape, score_block
from matchloom.operators.fuzzy import token_sort_ratio

from brute import grams as grams_of
from brute import lcs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé𝄞 ", max_size=150), min_size=2, max_size=12))
def test_lcs_matches_dynamic_programming(values):
    texts = Texts(values)
    i, j = np.nonzero(np.ones((len(values), len(values))))
    expected = [lcs(values[a], values[b]) for a, b in zip(i, j)]
    assert lcs_lengths(texts, i, j).tolist() == expected


@pytest.mark.parametrize("words", [0, 1, 32])
def test_lcs_long_texts(monkeypatch, words):
    monkeypatch.setattr(lcs_module, "_VECTOR_WORDS", words)
    rng = random.Random(words)
    values = ["".join(rng.choices("abcd", k=n)) for n in (0, 1, 63, 64, 65, 127, 128, 129, 700)]
    texts = Texts(values)
    i, j = np.nonzero(np.ones((len(values), len(values))))
    assert lcs_lengths(texts, i, j).tolist() == [lcs(values[a], values[b]) for a, b in zip(i, j)]


def test_token_sort_ratio(spark):
    rows = [
        ("red widget", "widget red", 100.0),
        ("red widget", "red widgets", 95.2),
        ("abc", "abd", 66.7),
        ("a", "b", 0.0),
        (" ", "  ", 100.0),
        ("", "x", 0.0),
        ("Red", "red", 66.7),  # raw values: case matters
        (None, "x", None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    got = df.select(F.round(token_sort_ratio(F.col("a"), F.col("b")), 1).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def block_table(pos, left, right, **payload):
    columns = {"pos": pa.array(pos, pa.int64()), "is_left": pa.array(left), "is_right": pa.array(right)}
    return pa.table({**columns, **payload})


def ranked(table, k):
    out = {}
    for r in table.to_pylist():
        out.setdefault(r["pos_a"], []).append((r["pos_b"], round(r["raw"], 7)))
    return out


@pytest.fixture
def small_pieces(monkeypatch):
    """Sizes that force every inner loop: many rectangles, a sparse rest, several rounds."""
    monkeypatch.setattr(tfidf, "_DENSE_COLUMNS", 6)
    monkeypatch.setattr(tfidf, "_SQUARE", 7)
    monkeypatch.setattr(fuzzy, "_SMALL_MEETING", 0)
    monkeypatch.setattr(fuzzy, "_RECT_LEFT", 9)
    monkeypatch.setattr(fuzzy, "_RECT_RIGHT", 13)
    monkeypatch.setattr(fuzzy, "_PAIR_ROUND", 5)


LAYOUTS = {
    "triangle": (lambda n: [True] * n, lambda n: [True] * n, False),
    "halves": (lambda n: [i % 3 == 0 for i in range(n)], lambda n: [i % 3 != 0 for i in range(n)], False),
    "two tables": (lambda n: [i < n // 2 for i in range(n)], lambda n: [i >= n // 2 for i in range(n)], True),
}


def meetings(layout, n):
    left, right, two_sided = LAYOUTS[layout]
    left, right = left(n), right(n)
    found = set()
    for i in range(n):
        for j in range(n):
            if left[i] and right[j] and i != j:
                found.add((i, j) if two_sided else (min(i, j), max(i, j)))
    return left, right, two_sided, found


def best_of(pairs, k, high_b):
    out = {}
    for i, j, s in sorted(pairs, key=lambda p: (p[0], -p[2], -p[1] if high_b else p[1])):
        if len(out.setdefault(i, [])) < k:
            out[i].append((j, round(float(s), 7)))
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("cutoff", [50, 80])
def test_cosine_block(small_pieces, layout, k, cutoff):
    rng = random.Random(k + cutoff)
    n = 45
    centres = [[rng.random() for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(n):
        base = centres[i % 4]
        ids = sorted(rng.sample(range(30), rng.randint(1, 25)))
        w = np.array([base[g] + 0.2 * rng.random() for g in ids])
        rows.append((ids, w / np.sqrt((w * w).sum())))
    rows[7] = rows[3]  # ties
    rows[11] = rows[3]
    left, right, two_sided, pairs = meetings(layout, n)
    table = block_table(
        range(n), left, right,
        size=pa.array([len(ids) for ids, _ in rows], pa.int32()),
        ids=pa.array([np.array(ids, np.int64).tobytes() for ids, _ in rows], pa.binary()),
        weights=pa.array([w.tobytes() for _, w in rows], pa.binary()),
    )
    got = score_block(tfidf.cosine_scorer(cutoff), Shape(k, True, two_sided))(table)
    scored = []
    for i, j in pairs:
        a, b = (dict(zip(*rows[x])) for x in (i, j))
        s = round(sum(v * b.get(g, 0.0) for g, v in a.items()), 9)
        if s >= cutoff / 100:
            scored.append((i, j, s * 100))
    assert ranked(got, k) == best_of(scored, k, True)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("k", [1, 3, 20])
@pytest.mark.parametrize("cutoff", [50, 80])
def test_fuzzy_block(small_pieces, layout, k, cutoff):
    rng = random.Random(k * cutoff)
    forms = [f"customer#{rng.randint(0, 99):05d}" if rng.random() < 0.6 else "".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(45)]
    left, right, two_sided, pairs = meetings(layout, len(forms))
    table = block_table(range(len(forms)), left, right, form=pa.array(forms))
    got = score_block(fuzzy.fuzzy_scorer(cutoff), Shape(k, False, two_sided))(table)
    scored = []
    for i, j in pairs:
        total, common = len(forms[i]) + len(forms[j]), lcs(forms[i], forms[j])
        if 200 * common >= cutoff * total:
            scored.append((i, j, 200 * common / total if total else 100.0))
    assert ranked(got, k) == best_of(scored, k, False)


def test_packed_grams_are_those_of_the_definition(monkeypatch):
    from matchloom.functions import grams

    texts = ["", " ", "a", "ab cd", " lead", "trail ", "a  b", "über straße 日本語", "x" * 50, "a b \U0001f600\U0001f601", "nul\x00l n", "ab cd"] * 3
    want = [dict(grams_of(t)) for t in texts]
    for chunk, alphabet in ((1 << 19, 65_534), (3, 65_534), (1 << 19, 5)):
        monkeypatch.setattr(grams, "_CHUNK_CHARS", chunk)
        monkeypatch.setattr(grams, "_ALPHABET", alphabet)
        got = []
        for _, _, names, times in grams.gram_lists(texts):
            got += [dict(zip(n, c)) for n, c in zip(names.to_pylist(), times.to_pylist())]
        assert got == want


@pytest.mark.parametrize("cutoff", [60, 85])
def test_vectors_of_both_paths_are_equal(spark, monkeypatch, cutoff):
    keys = [f"acme {i % 7} trading {'ltd' * (i % 3)} über{i}" for i in range(60)] + [" ", "a"]
    corpus = spark.createDataFrame([("a", i, k) for i, k in enumerate(keys)], "side string, pos long, key string")

    def rows():
        out = {}
        for r in tfidf.key_vectors(corpus, len(keys), cutoff).collect():
            ids, weights = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], np.float64)
            out[r["pos"]] = sorted((round(w, 9), i in set(r["prefix"])) for i, w in zip(ids, weights))
        return out

    near = rows()
    monkeypatch.setattr(tfidf, "_VOCABULARY_BROADCAST", 3)
    assert rows() == near and len(near) == len(keys) - 1


def test_vectors_of_long_keys_are_built_in_parts(spark, keys_of, monkeypatch):
    """A worker never holds the weights of a whole batch of long texts, and is sent few of these at once."""
    keys = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)]
    corpus = tfidf.idf_corpus(keys_of(keys))
    terms = tfidf.key_terms(corpus).toArrow().combine_chunks().to_batches()[0]
    grams = sorted({g for row in terms["grams"].to_pylist() for g in row})
    told = SimpleNamespace(value=(pa.array(grams), np.arange(len(grams)), np.ones(len(grams))))
    whole = pa.Table.from_batches(tfidf._vector_builder(told, 20, 85)(iter([terms])))
    monkeypatch.setattr(tfidf, "_GRAMS_AT_ONCE", 500)
    parts = list(tfidf._vector_builder(told, 20, 85)(iter([terms])))
    assert len(parts) > 5 and pa.Table.from_batches(parts).equals(whole)
    _, at_once = tfidf._key_vectors(corpus, 20, None)
    assert at_once <= 5
