"""Spelling variants: near words, forms and roots against comparing all pairs, with leaves and tiles forced small."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import spelling

SCHEMA = "word string, n long"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, x) for x, m in counts.items() if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = [form, n, len(others), counts[form] if form else None]
    rows = []
    for w, (form, n, k, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, form_n))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(seed, letters, size, lengths):
    rng = random.Random(seed)
    out = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([3, 4, 6, 12, 30, 100]) for _ in range(size)}
    for w in list(out)[: size // 4]:
        at = rng.randrange(len(w))
        out.setdefault(w[:at] + rng.choice(letters) + w[at + 1 :], 5)
        out.setdefault(w[:at] + rng.choice(letters) + w[at:], 3)
    return out


@pytest.mark.parametrize("letters,size,lengths,leaf", [("ab", 400, range(5, 11), 3), ("abcdeéÿ", 600, (5, 6, 7), 20), ("abcdefghijklmnop", 500, (5, 5, 5, 9), 2048), ("aab", 300, (12, 13), 1)])
def test_against_all_pairs(spark, monkeypatch, letters, size, lengths, leaf):
    monkeypatch.setattr(spelling, "_LEAF", 4 * leaf)
    monkeypatch.setattr(spelling, "_LEAF_SAMPLE", 2)
    counts = vocabulary(size, letters, size, lengths)
    table = spark.createDataFrame(list(counts.items()), SCHEMA).repartition(3)
    whole = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda distinct, n: whole(distinct, n, leaf))
    assert rows_of(spelling.variants(table)) == brute(counts)


def test_sampled_planes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_SAMPLE", 60)
    monkeypatch.setattr(spelling, "_LEAF_SAMPLE", 2)
    monkeypatch.setattr(spelling, "_LEAF", 16)
    counts = vocabulary(7, "abcdef", 500, (5, 6, 11, 40))
    counts |= {"x" * 70_000: 9, "x" * 69_999: 4, "y" + "x" * 69_999: 3}
    assert rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), SCHEMA))) == brute(counts)


def test_anagrams_are_never_near():
    coded = [b"abcde", b"acbde", b"edcba", b"abcdf", b"abcd"]
    i, j = spelling.near_pairs(coded, np.array([2, 2, 2, 2, 1]))
    assert {frozenset((coded[a], coded[b])) for a, b in zip(i, j)} == {frozenset((b"abcde", b"abcdf")), frozenset((b"abcde", b"abcd")), frozenset((b"abcdf", b"abcd"))}


def test_words_of_documents(spark):
    texts = [(i, "Straße Über naïve Œuvre x×y÷z " * 2 + "ABCDEFG abcdefg " * 40 + "l'été 日本abcde-été") for i in range(60)]
    rows = [*texts, (None, "Hello hello HELLO hellO"), (None, None), (1, ""), (61, "q" * 100_000 + " " + "tiny few"), texts[0], texts[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    wide = docs.select("*", *[F.lit(0).alias(c) for c in ("word", "n", "ident", "form", "root")])
    assert {r["word"]: r["n"] for r in spelling.words(wide, damage=True).collect()} == want
    assert rows_of(spelling.report(wide)) == brute(want)
    plain = {r["word"]: r["n"] for r in spelling.words(docs, min_length=1, min_count=1).collect()}
    assert plain["hello"] == 4 and plain["x×y÷z"] == 124 and plain["uvre"] == 124
    assert spelling.report(docs.limit(0)).count() == 0 and spelling.report(docs.filter("text IS NULL")).count() == 0


def test_chains_end_at_the_last_form(spark):
    word, counts = "abcdefghijklmno", {}
    for step in range(12):
        counts[word] = 3 * 2**step
        word = word[:step] + "z" + word[step + 1 :]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(counts.items()), SCHEMA)).collect()}
    assert set(got.values()) == {max(counts, key=counts.get)}
