"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import chat, decontam, langid, lines, minhash, permutation, pieces, toxicity, windows, xent

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(f"{WORDS[i % 19]}{i * i % 997}" for i in range(60_000))
PASSAGE = " ".join(WORDS[:15])
ROWS = [
    (1, f"Start here {PASSAGE} and go on with something else entirely", "en", "a", 1),
    (2, f"Other words {PASSAGE} before the end of it all", "en", "a", 2),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "fr", None, 3),
    (6, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (None, f"No id {PASSAGE} at all in this row of the table", "en", "c", 9),
    (8, "123 ... !!!", None, None, None),
    (9, "Ein kurzer Text über nichts, für alle.", "de", "d", 8),
    (9, "Ein kurzer Text über nichts, für alle.", "de", "d", 8),
    (9, "Same id but another text with quite other words inside of it", "en", "d", 8),
]
EXTRA = ["language", "mark", "cut", "spans", "bucket", "toxicity", "piece_ids", "group", "kept_id", "benchmark_hits", "gone", "lines_removed", "xent", "lang_pred", "score", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, PASSAGE), (2, None), (None, PASSAGE), (3, ""), (4, "kurzer TEXT"), (4, "kurzer TEXT")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language(spark, docs, none, wide):
    got = langid.report(docs).collect()
    assert len(got) == len(ROWS)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {3, 4, 5, 8} and all(r["score"] == 0 for r in got if r["doc_id"] in und)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.report(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none, F.lit(True)))[0].select("language.*").collect()} == {"und"}
    kept = langid.drop_unknown(wide)
    assert kept.columns == wide.columns and kept.count() == 8


def test_substrings(docs, none, wide):
    got = by_id(windows.report(docs))
    assert len(got) == len(ROWS)
    removed = {r[0]: r[2] for r in got if r[0] != 9}
    n = len(LONG.split())
    assert removed == {None: 0, 1: 0, 2: 15, 3: 0, 4: 0, 5: 0, 6: 0, 7: n, 8: 0}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r[3] == empty for r in got if r[0] in (3, 4, 5, 7))
    assert all(r[2] == 0 for r in got if r[0] == 9)
    assert windows.report(none).count() == 0
    out, name = windows.remove_repeats(wide)
    assert out.columns == [*wide.columns, name] and name not in wide.columns and out.count() == len(ROWS)


def test_neighbours(spark):
    v = [float(i % 7 + 1) for i in range(8)]
    rows = [(i, [x + (i % 5) * 0.1 for x in v]) for i in range(100, 160)]
    odd = [(200, None), (300, [0.0] * 8), (400, [float("nan")] * 8), (500, [float("inf"), *v[1:]]), (600, [None, *v[1:]]), (700, [1.0]), (None, v), (100, rows[0][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = permutation.report(table).orderBy("rank").collect()
    # exact ties of equal vectors go to the smaller id, never to the query itself
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(100, 100 + 5 * i, 0.0) for i in range(1, 11)]
    few = permutation.report(table.filter("vec_id between 100 and 103")).collect()
    assert len(few) == 3 and permutation.report(table.limit(0)).count() == 0
    assert permutation.report(table.filter("vec_id = 100")).count() == 0


def test_toxicity(spark, docs, none, wide):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (9, 0), (7, None), (None, 1), (50, 1)], "doc_id long, toxic int")
    for got in (toxicity.report(docs, labels), toxicity.report(docs, labels.limit(0))):
        got = got.collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.report(none, labels).count() == 0
    out, name = toxicity.score(wide, toxicity.fit(docs, labels))
    assert out.columns == [*wide.columns, name] and out.count() == len(ROWS)


def test_near_duplicates(docs, none, wide):
    got = minhash.near_duplicates(docs, 4)
    rows = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got.collect()}
    assert got.count() == len(ROWS)
    assert [k for k in rows if k[0] in (3, 4, 5)] and all(rows[i, 0] == (i, True) for i in (3, 4, 5))
    n = len(set(zip(*[LONG.split()[i:] for i in range(4)])))
    assert rows[6, n] == (6, True) and rows[7, n] == (6, False)
    assert rows[8, 1] == (8, True)
    kept = minhash.keep_one(wide)
    assert kept.columns == wide.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "9", "None"])
    assert minhash.report(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_decontamination(docs, none, wide, bench):
    got = {r[0]: r[1:] for r in by_id(decontam.report(docs, bench))}
    both = hashlib.sha256(b"1").hexdigest()
    assert got[1][1:] == (15, 1, both, True) and got[None][1:] == (15, 1, both, True)
    assert got[3] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    clean = decontam.drop_contaminated(wide, bench)
    assert clean.columns == wide.columns and clean.count() == 7
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)
    assert decontam.report(none, bench).count() == 0
    parts = decontam.scan(docs, bench, part_words=1)[0].select("benchmark_hits").collect()
    assert parts == decontam.scan(docs, bench)[0].select("benchmark_hits").collect()
    out, name = decontam.remove_spans(docs.filter("doc_id = 2"), bench)
    assert out.first()[name] == "other words before the end of it all"


def test_lines(spark, none, wide):
    line = "the quick brown fox jumps over the lazy dog near the river bank on a very sunny day in may"
    near = line.replace("sunny", "sunnny")
    rows = [(1, f"{line}\nfirst\n{line}"), (2, f"a\n\n{line.upper()}!\nb"), (3, None), (4, ""), (None, line), (5, near), (6, "\n\n"), (2, f"a\n\n{line.upper()}!\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lines.drop_repeated_lines(docs, bits=20)[0].collect()), key=str)
    want = [(1, f"{line}\nfirst", 1), (2, "a\n\nb", 1), (2, "a\n\nb", 1), (3, None, 0), (4, "", 0), (None, line, 0), (5, "", 1), (6, "\n\n", 0)]
    assert got == sorted(want, key=str)
    out, name = lines.drop_repeated_lines(wide)
    assert out.columns == [*wide.columns, name] and name not in wide.columns and out.count() == len(ROWS)
    assert lines.report(none).count() == 0
    assert {r["n_lines"] for r in lines.report(docs).collect() if r["doc_id"] == 3} == {0}


def test_pieces(docs, none, wide):
    got = pieces.report(docs).collect()
    assert len(got) == len(ROWS) and all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (3, 4)} == {0}
    out, name = pieces.encode(wide, pieces.read_model())
    assert out.columns == [*wide.columns, name] and name not in wide.columns
    assert pieces.report(none).count() == 0


def test_chat(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a <|end|> b"), (1, 0, None, "hi"), (1, 1, "assistant", None), (2, 0, "user", "alone"), (4, 1, "assistant", "x"), (None, 0, "user", "x"), (5, None, "user", "x"), (0, 0, "user", "hi")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.report(rows).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["n_common"] == 1
    assert got[0]["chosen"] == "<|assistant|>\na < |end|> b<|end|>\n" and got[0]["rejected"] == "<|assistant|>\n<|end|>\n"
    assert got[2]["identical"] and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[4]["prompt"] == got[4]["rejected"] == "" and not got[4]["identical"]
    assert chat.report(rows.limit(0)).count() == 0
    pairs = spark.createDataFrame([(1, None, None), (2, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")])], "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    done = {r["id"]: r for r in chat.format_pairs(pairs).collect()}
    assert done[1]["identical"] and done[2]["prompt"] == "<|user|>\nq<|end|>\n"
    whole, span = done[2]["prompt"] + done[2]["chosen"], done[2]["chosen_spans"][0]
    assert whole[span["start"] : span["end"]] == "a<|end|>\n"


def test_cross_entropy(spark, docs, none, wide):
    labels = spark.createDataFrame([(1, 1), (2, 1), (1, 1), (3, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in xent.report(docs, labels).collect()}
    assert got[3]["score"] == got[4]["score"] == 0 and got[3]["n_tokens"] == 0
    assert got[1]["score"] < 0 < got[6]["score"]
    assert all(r["score"] == 0 or r["n_tokens"] for r in xent.report(docs, labels.limit(0)).collect())
    assert xent.report(none, labels).count() == 0
    out, name = xent.score(wide, xent.fit(docs, F.lit(True)))
    assert out.columns == [*wide.columns, name] and name not in wide.columns


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, none, wide, bench, tmp_path, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    for table in (none, wide):
        got = run(spark, table, str(tmp_path))
        assert got.columns[: len(table.columns)] == table.columns
        assert got.dtypes[: len(table.columns)] == table.dtypes
        assert stage == 4 or len(got.columns) == len(table.columns)
        assert (got.count() == 0) == (table is none)
