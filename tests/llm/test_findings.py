"""One test for each finding of a review round."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.llm import minhash, xent
from matchloom.plans import scratch


def _plain_losses(text, counted):
    """Target and background loss of a text, by counting ``(is_target, text)`` plainly."""
    word, pair, before = ([Counter(), Counter()] for _ in range(3))
    for target, one in counted:
        w = one.split()
        for side in [1] + [0] * target:
            word[side].update(w)
            pair[side].update(zip([None, *w], w))
            before[side].update([None, *w][: len(w)])
    size, totals, w = len(word[1]) + 1, [c.total() for c in word], text.split()
    for side, s in ((0, 1.0), (1, totals[0] / totals[1])):
        p_word = {x: (word[side][x] * s + 0.5) / (totals[side] * s + 0.5 * size) for x in w}
        yield -sum(math.log((pair[side][a, x] * s + 4 * p_word[x]) / (before[side][a] * s + 4)) for a, x in zip([None, *w], w)) / len(w)


def test_cross_entropy_writes_less_than_its_input(spark, tmp_path, monkeypatch):
    """Pairs of words are no rows of an intermediate table."""
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path))
    random.seed(3)
    rows = [(i, " ".join(f"w{random.randrange(3000)}" for _ in range(2000))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    got = xent.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels).collect()
    assert len(got) == 60 and all(r["n_tokens"] == 2000 for r in got)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < sum(len(text) for _, text in rows)


def test_cross_entropy_of_other_documents(spark, monkeypatch):
    """Counted documents and scored ones differ; hot words, several blocks, repeated and unseen words."""
    monkeypatch.setattr(xent, "HOT_SHARE", 1 / 50)
    random.seed(4)
    text = lambda: " ".join(random.choice(("the", "of", f"w{random.randrange(60)}")) for _ in range(random.randrange(1, 50)))
    counted = [(i % 3 == 0, text()) for i in range(80)]
    asked = [text() for _ in range(30)] + [counted[0][1], counted[0][1], "new words the new", "the", "w1"]
    models = xent.fit(spark.createDataFrame(counted, "target boolean, body string").repartition(5), F.col("target"), "body")
    assert 2 <= len(models.hot["word"]) < models.vocabulary - 1
    done, out = xent.score(spark.createDataFrame([(x,) for x in [*asked, None, " "]], "text string").repartition(4), models)
    got = done.select("text", f"{out}.*").collect()
    assert len(got) == len(asked) + 2
    for r in got:
        want = tuple(_plain_losses(r["text"], counted)) if (r["text"] or "").strip() else (0.0, 0.0)
        assert r["n_tokens"] == len((r["text"] or "").split())
        assert math.isclose(r["target_loss"], want[0], abs_tol=1e-9) and math.isclose(r["background_loss"], want[1], abs_tol=1e-9)


def test_family_of_near_copies_leaves_the_trees_early(spark, monkeypatch):
    """A family much larger than a leaf, and a few texts beside it that are linked with one member each."""
    rows_of, plain = Counter(), minhash.materialise_counted

    def counted(df, label, **metrics):
        stored, seen = plain(df, label, **metrics)
        rows_of[label] += stored.count()
        return stored, seen

    monkeypatch.setattr(minhash, "materialise_counted", counted)
    random.seed(5)
    base = [f"a{i}" for i in range(400)]
    texts = [" ".join(base[:at] + [f"x{at}"] + base[at + 1 :]) for at in range(10, 210)]
    # 76 to 88 words less than the base: similar to their own member only, and to each other where these are near
    texts += [" ".join(base[:at] + [f"x{at}"] + base[at + 1 : 400 - 2 * at]) for at in (38, 40, 42, 44)]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)] + [(900, "quite another text of six words")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 4, leaf_rows=12).collect()}
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root)) | {900: 900}
    assert rows_of["members"] < 30 * len(texts)


def test_cross_entropy_bucket_fits_a_worker(monkeypatch):
    """A full bucket of words takes a task well below half of an executor's part for Python."""
    monkeypatch.setattr(xent, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    hot = {c: np.empty(0) for c in xent._COUNTS} | {"word": np.empty(0, np.uint64)}
    models = xent.Models(None, None, "", None, hot, (1e6, 4e6), (1e3, 4e3), 50_001)
    draw = np.random.default_rng(5)
    text = lambda: " ".join(map(str, draw.integers(0, 50_000, 1000)))
    texts = [text() for _ in range(xent._BUCKET_WORDS // 1000 + 1)]
    rows = pa.RecordBatch.from_pydict({"target": [i % 4 == 0 for i in range(len(texts))], "key": [b"%16d" % i for i in range(len(texts))], "text": texts})
    bucket = pa.Table.from_batches(xent._blocks(models, 1, True, True)(iter([rows])))
    tracemalloc.start()
    got = xent._sum_bucket(models)(bucket)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == bucket.num_rows and peak < 250e6, peak


def test_near_dedup_sends_no_texts_through_a_shuffle(spark):
    """Kept rows are picked where they lie; only rows that repeat id and text meet once more."""
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(i, words(i // 2), f"s{i}") for i in range(40)] + [(None, words(90), "n"), (99, None, "t"), (99, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = minhash.keep_one(docs)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    want = [r for r in rows if r[0] is None or r[0] > 40 or r[0] % 2 == 0]
    assert Counter(map(tuple, kept.collect())) == Counter(want)
    again = docs.unionAll(docs.filter("doc_id is null or doc_id in (4, 5, 99)"))
    assert Counter(map(tuple, minhash.keep_one(again).collect())) == Counter(want)


def test_pipeline_hands_few_rows_to_a_worker_at_once(spark, tmp_path, monkeypatch):
    """Batches of 10,000 whole texts took more memory than an executor had left after four stages."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("language ID", sizes)])
    got = [r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 5000 and max(got) <= corpus_pipeline.BATCH_ROWS == 1000
