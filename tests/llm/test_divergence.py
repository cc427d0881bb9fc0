"""Source divergence: whole results against plain counting, with blocks of terms and of groups forced small."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import divergence

SCHEMA = "text string, lang string, source string"


def brute(rows, min_docs, top=10):
    rows = [tuple(c or "" for c in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    docs = defaultdict(Counter)
    for (_, lang, _), found in zip(rows, terms):
        docs[lang].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in docs.items()}
    counts, whole = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), found in zip(rows, terms):
        some = [t for t in found if t in kept[lang]]
        counts[lang, source].update(some)
        whole[lang].update(some)

    def p(counter, lang, term):
        return 1 + 10**9 * (counter[term] + 2) // (sum(counter.values()) + 2 * len(kept[lang]))

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    out = []
    for (lang, source), mine in counts.items():
        pairs = [(-sum(f(p(mine, lang, t), p(theirs, lang, t)) for t in kept[lang]), s) for (other, s), theirs in counts.items() if other == lang and s != source]
        above = [(-f(p(mine, lang, t), p(whole[lang], lang, t)), t) for t in kept[lang] if mine[t] and p(mine, lang, t) > p(whole[lang], lang, t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=300, sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("wort", "Été", "x", "日本") for b in "abcdefghij"]
    out = []
    for _ in range(n):
        s = rng.randrange(sources)
        text = rng.choice((" ", "7", "-")).join(words[min(int(rng.expovariate(0.1 + 0.02 * s)), 39)] for _ in range(rng.randrange(40)))
        out.append((text, rng.choice(["en", "de", None]), rng.choice([f"s{s}", None, "hot", "hot"])))
    return out


def test_edges(spark):
    rows = [("a b A", "en", "x"), ("a b", "en", "y"), (None, "en", "z"), ("", "fr", "x"), ("q", "fr", None), (None, None, None), ("123 !", "", "w"), ("b b", "en", "x"), ("b b", "en", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("n", "term", "rank", "value", "item", "v", "p", "doc_id")])
    for min_docs in (1, 2, 100):
        assert rows_of(divergence.audit(wide, min_docs=min_docs)) == brute(rows, min_docs)
    assert divergence.report(docs.limit(0)).count() == 0
    long = [("ab " * 200_000 + "cd", "en", "x"), ("cd", "en", "y")]
    assert rows_of(divergence.audit(spark.createDataFrame(long, SCHEMA), min_docs=1)) == brute(long, 1)


@pytest.mark.parametrize("terms,groups,rows", [(1024, 64, 64), (3, 2, 2), (7, 1, 64)])
def test_blocks_against_counting(spark, monkeypatch, terms, groups, rows):
    for name, value in (("_BLOCK", terms), ("_GROUPS", groups), ("_ROWS", rows)):
        monkeypatch.setattr(divergence, name, value)
    docs = corpus(terms)
    assert rows_of(divergence.report(spark.createDataFrame(docs, SCHEMA).repartition(5))) == brute(docs, 10)


def test_shuffled_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_BROADCAST_BYTES", -1)
    docs = corpus(5)
    assert rows_of(divergence.report(spark.createDataFrame(docs, SCHEMA))) == brute(docs, 10)


def test_level_products_are_the_joint_tables():
    rng = np.random.default_rng(1)
    level = rng.integers(0, 4, (200, 5))
    p = level * 1000 + np.arange(5) * 7 + 1
    got = defaultdict(int)
    for a, b, times, price in divergence.level_products(level, p):
        for i, j, n, each in zip(a, b, times, price):
            got[i, j] += int(n * each)
    want = {(i, j): sum(int((p[t, i] - p[t, j]) ** 2 // (p[t, i] + p[t, j])) for t in range(200)) for i in range(5) for j in range(i + 1, 5)}
    assert got == want


def test_large_counts_stay_exact(spark):
    n, total, v = 3 * 10**12 + 1, 9 * 10**14 + 7, 10**7
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t"), F.lit(v).alias("v"))
    assert row.select(divergence._p("n", "t", "v")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
