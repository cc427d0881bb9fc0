"""Operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from matchloom.llm import decontam, langid, lines, minhash, permutation, pieces, toxicity, windows
from matchloom.llm.components import components
from matchloom.llm.tables import hashed_out, load
from matchloom.llm.words import WordHashes, letter_words, rolling, sliding_min

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    names = {n.split("_")[0] for n in entry_points.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op5_minhash_near_dedup", "op6_decontamination", "op9_chat_formatting"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(entry_points.oracle_sql()[name]).fetchdf()
    got = entry_points.queries()[name](spark, SF).toPandas()
    plain = lambda d: sorted(map(str, d[sorted(want.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_spelling_variants", "op13_exact_dedup"])
def test_rows_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    asked = con.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    got = entry_points.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(asked.fetchall(), key=str)


def test_rolling_hashes():
    h = WordHashes().of([b"a", b"b", b"c", b"a", b"b"])
    r = rolling(h, 2)
    assert len(r) == 4 and r[0] == r[3] and len(set(r.tolist())) == 3 and len(rolling(h, 6)) == 0
    x = np.array([5, 1, 4, 2, 8, 7, 3, 9, 6], np.uint64)
    for k in range(1, 9):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(0, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def texts_with_copies(seed, n=120, vocabulary=400, length=60, change=0.03):
    random.seed(seed)
    out = []
    while len(out) < n:
        base = [f"w{random.randrange(vocabulary)}" for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(random.choice((0, 0, 1, 6))):
            out.append(" ".join(w if random.random() > change else f"x{random.randrange(99)}" for w in base))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize("limits", [{"leaf_rows": 4, "depth": 3}, {"leaf_rows": 3, "leaf_hashes": 200, "depth": 2, "trees": 8}])
def test_near_duplicates_against_all_pairs(spark, limits):
    """Small leaves and depths send nodes through branching, chunks and the tiles of what is left."""
    rows = texts_with_copies(3) + [(1000 + i, t) for i, t in texts_with_copies(4, 60, change=0.005, length=80)[:1] * 5]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, **limits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_overlaps():
    random.seed(1)
    sets = [np.unique(np.array([random.randrange(3000) for _ in range(random.randrange(1, 900))], np.uint64)) for _ in range(9)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert minhash.overlaps(sets).tolist() == want


def test_windows_over_small_slices(spark, monkeypatch):
    """Slices of a few documents give the same result as one slice for each task."""
    rows = spark.createDataFrame(texts_with_copies(8, 60, 30), "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, windows.report(rows, 5).collect()))
    seen, out = {}, []
    for i, t in sorted((r["doc_id"], r["text"].split()) for r in rows.collect()):
        gone = {j + d for j in range(len(t) - 4) if seen.setdefault(tuple(t[j : j + 5]), i) < i for d in range(5)}
        out.append((i, len(gone)))
    assert [(r[0], r[2]) for r in want] == out


def test_decontamination_against_all_windows(spark):
    random.seed(2)
    words = "Aa bB c1 ü-d e".split()
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    docs, bench = [(i, make(random.randrange(0, 60))) for i in range(80)], [(i, make(random.choice((0, 1, 3, 7, 8, 9)))) for i in range(12)]
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), 6)
    want = {}
    for doc, text in docs:
        w, hit, items = letter_words(text), set(), set()
        for item, other in bench:
            o = letter_words(other)
            k = min(6, len(o))
            for j, i in itertools.product(range(len(o) - k + 1 if k else 0), range(max(0, len(w) - k + 1))):
                if w[i : i + k] == o[j : j + k]:
                    hit.update(range(i, i + k))
                    items.add(item)
        want[doc] = (len(w), len(hit), len(items))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()} == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bits", [3, 8])
def test_lines_against_all_pairs(spark, bits):
    random.seed(6)
    base = [" ".join(random.choice("red blue green tree house river stone cloud winter summer".split()) + str(random.randrange(4)) for _ in range(24)) for _ in range(12)]
    made = []
    for _ in range(90):
        line = list(random.choice(base))
        for _ in range(random.randrange(4)):
            line[random.randrange(len(line))] = random.choice("abc ")
        made.append("".join(line))
    rows = [(i, "\n".join(made[3 * i : 3 * i + 3])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sims = {(r["doc_id"], r["line_no"]): (r["sim"], bytes(r["id"])) for r in lines.signatures(docs, 5).collect()}
    forms = {k: " ".join(w for w in re.split(r"[\W_]+", re.sub("[0-9]", "0", rows[k[0]][1].split("\n")[k[1]].lower())) if w) for k in sims}
    first = {k: k for k in sims}
    for a, b in itertools.combinations(sorted(sims), 2):
        n = max(len(forms[a]), len(forms[b]))
        close = (sims[a][0] ^ sims[b][0]).bit_count() <= bits and 10 * min(len(forms[a]), len(forms[b])) >= 9 * n
        if sims[a][1] == sims[b][1] or (close and edit_distance(forms[a], forms[b]) <= n // 10):
            x, y = first[a], first[b]
            first = {k: min(x, y) if v in (x, y) else v for k, v in first.items()}
    want = {i: "\n".join(s for j, s in enumerate(t.split("\n")) if first.get((i, j), (i, j)) == (i, j)) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs, bits=bits)[0].collect()}
    assert got == want and any(first[k] != k for k in first)


def test_line_dedup_is_native(spark):
    got = corpus_pipeline.line_dedup(spark, load(spark, SF, "documents"), SF)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_blocks():
    for classes, bits in ((10, 3), (1 << 23, 3), (1 << 33, 3), (10, 8)):
        masks = lines.block_masks(classes, bits)
        random.seed(0)
        for _ in range(200):
            flips = sum(1 << b for b in random.sample(range(63), bits))
            assert any(flips & m == 0 for m in masks)


def test_neighbours_recall(spark):
    rows = load(spark, SF, "embeddings")
    got = permutation.report(rows).collect()
    data = rows.orderBy("vec_id").toPandas()
    x, ids = np.array(data.embedding.tolist(), float), data.vec_id.to_numpy()
    found = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert all(math.isclose(s, far[ids == i][0], abs_tol=1e-12) for i, s in mine.items())
        found, total = found + len(mine.keys() & set(ids[best])), total + len(best)
    assert found >= 0.9 * total


def test_language_held_out(spark):
    docs = load(spark, SF, "documents")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert got and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    far = docs.limit(1).select(F.lit(1).alias("doc_id"), F.lit("日本語のテキスト " * 20).alias("text"))
    out, name = langid.predict(far, langid.fit(docs, ~hashed_out("doc_id", 3, 1)))
    assert out.first()[name]["rejected"]


def test_kneser_ney_sums_to_one():
    words = ["abab", "abba", "baba", "aab", "b"]
    model = toxicity.KneserNey.fit(words, np.array([2.0, 0, 1, 0, 0]), np.array([0.0, 3, 1, 1, 4]))
    e = model.evidence([*words, "zz"])
    assert np.isfinite(e).all() and e[0] > 0 > e[1]


def test_toxicity_on_planted_words(spark):
    random.seed(9)
    words = ["".join(random.choice("aeioukmnrst") for _ in range(random.randrange(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = random.choices(words, k=60)
        if i % 5 == 0:
            for _ in range(3):
                text[random.randrange(60)] = "grobx" + random.choice(("ung", "heit", "er", ""))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    got = toxicity.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    assert right >= 0.97 * len(got)


def test_pieces_equal_the_library(spark):
    texts = [r["text"] for r in load(spark, SF, "documents").select("text").collect()]
    random.seed(3)
    texts += ["", " ", "  a", "\n\n x\ty", "日本語 テスト\x00", "ab" * 500, "    " * 9, "🎉é́"]
    texts += ["".join(random.choice("ab  \n\té日e.thing") for _ in range(random.randrange(60))) for _ in range(300)]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    mine = pieces.Encoder(pieces.read_model())
    got = [x.tolist() for x in mine.encode(texts)]
    assert got == model.encode(texts)
    assert [pieces.decode_ids(x, mine.pieces) for x in got] == texts


def test_viterbi_against_all_paths():
    names = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "bab"]
    scores = [-3.0, -3.5, -4.0, -4.2, -6.1, -2.0, -4.4, -5.9]
    p = pieces.Pieces(names, list(range(1, 9)), scores, {}, 0, "unigram", True, [b"?"] + [n.encode() for n in names])
    encoder = pieces.Encoder(p)
    table = dict(zip(names, scores))

    def best(s):
        if not s:
            return 0.0
        return max(([table.get(s[:n], encoder.floor if n == 1 else -math.inf) + best(s[n:]) for n in range(1, len(s) + 1)]))

    for text in ("abab", "babaab", "aabcb", "a b aba", ""):
        ids = next(encoder.encode([text])).tolist()
        got = sum(encoder.floor if i == 0 else scores[i - 1] for i in ids)
        assert math.isclose(got, sum(best(s) for s in encoder.segments(text)), rel_tol=1e-6)


def test_pipeline_against_brute_force(spark):
    """Stage by stage: what each keeps follows from plain rules on the table before it."""
    docs, bench = load(spark, SF, "documents"), [tuple(r) for r in load(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for _, t in bench if (w := letter_words(t)) for i in range(max(1, len(w) - 9))}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys() and docs.count() == len(after)
        if k == 0:
            assert len(after) >= 0.99 * len(before)
        if k == 1:
            assert after.keys() == before.keys() and all(set(r["text"].split("\n")) <= set(before[i]["text"].split("\n")) | {""} for i, r in after.items())
            long = [w for r in after.values() for s in r["text"].split("\n") if len(w := " ".join(x for x in re.split(r"[\W_]+", re.sub("[0-9]", "0", s.lower())) if x)) and len(w.split()) >= 5]
            assert len(long) == len(set(long))
        if k == 2:
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := r["text"].lower().split()) else set() for i, r in before.items()}
            links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            least = {i: i for i in sets}
            for _ in range(20):
                for a, b in links:
                    least[a] = least[b] = min(least[a], least[b])
            assert after.keys() == {i for i in least if least[i] == i}
        if k == 3:
            dirty = {i for i, r in before.items() if any(tuple(w[j : j + n]) in grams for w in [letter_words(r["text"])] for n in {len(g) for g in grams} for j in range(len(w) - n + 1))}
            assert after.keys() == before.keys() - dirty
        if k == 4:
            p = pieces.read_model()
            assert all(pieces.decode_ids(r["piece_ids"], p) == r["text"] for r in after.values())
