import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import report, review

SCHEMA = "session string, seq long, ts timestamp, choice string, note string"


def log(spark, sessions):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [
        (name, n * 3, start + timedelta(seconds=10 * n), c, f" {c}{n}\t")
        for name, choices in sessions.items()
        for n, c in enumerate(choices)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def stack(choices, n_matches):
    """Plain replay: the review stops once every match is decided."""
    done = []
    for c in choices:
        if len(done) >= n_matches:
            break
        if c == "U":
            if done:
                done.pop()
        else:
            done.append(c)
    return done


def decided(df):
    out = {}
    for r in df.orderBy("session", "match_id").collect():
        out.setdefault(r["session"], []).append((r["match_id"], r["choice"]))
    return out


@pytest.mark.parametrize(
    "choices, n, expected",
    [
        ("ABFS", 9, "ABFS"),
        ("AUB", 9, "B"),
        ("UA", 9, "A"),
        ("ABUUUFSUB", 9, "FB"),
        ("AB", 1, "A"),
        ("UAU", 9, ""),
        ("AUUB", 9, "B"),
        ("ABUB", 2, "AB"),
    ],
)
def test_replay_cases(spark, choices, n, expected):
    events = review.in_range(review.replay_index(log(spark, {"s": choices})), n)
    got = decided(review.effective_decisions(events))
    assert got.get("s", []) == [(i + 1, c) for i, c in enumerate(expected)]


@pytest.mark.parametrize("block", [100, 700, 65536])
def test_replay_against_a_stack(spark, monkeypatch, block):
    monkeypatch.setattr(review, "PART_EVENTS", block)
    rng = random.Random(block)
    sessions = {f"s{i}": "".join(rng.choices("ABFSUUU", k=rng.randint(1, 40))) for i in range(150)}
    events = review.in_range(review.replay_index(log(spark, sessions)), 6)
    got = decided(review.effective_decisions(events))
    for name, choices in sessions.items():
        assert got.get(name, []) == [(i + 1, c) for i, c in enumerate(stack(choices, 6))], choices


@pytest.mark.parametrize("flat", [1, 1024])
def test_replay_of_one_long_sparse_session(spark, monkeypatch, flat):
    """Parts hold about as many events however far apart their numbers are, and carries go over runs of parts."""
    monkeypatch.setattr(review, "PART_EVENTS", 60)
    monkeypatch.setattr(review, "FLAT_PARTS", flat)
    rng = random.Random(1)
    choices = "".join(rng.choices("ABFSUU", k=1500))
    events = log(spark, {"s": choices}).withColumn("seq", F.col("seq") * F.col("seq") * 10**9)
    replayed = review.replay_index(events)
    got = {r["seq"]: r["idx"] for r in replayed.select("seq", "idx").collect()}
    depth, want = 0, []
    for c in choices:
        depth = max(depth - 1, 0) if c == "U" else depth + 1
        want.append(depth)
    assert [got[seq] for seq in sorted(got)] == want
    assert decided(review.effective_decisions(review.in_range(replayed, 10**6)))["s"] == [(i + 1, c) for i, c in enumerate(stack(choices, 10**6))]


@pytest.fixture
def matches(spark):
    rows = [
        (i + 1, 90.0 - i, f"a{i}", f"b{i}", (i, f"a{i}"), (i + 50, f"b{i}")) for i in range(4)
    ]
    return spark.createDataFrame(
        rows,
        "match_id long, score double, match_a string, match_b string, "
        "row_a struct<id:long,name:string>, row_b struct<id:long,name:string>",
    )


@pytest.mark.parametrize("master", [False, True])
def test_decision_records(spark, matches, master):
    events = review.replay_index(log(spark, {"s": "ABFS"}))
    decisions = review.effective_decisions(review.in_range(events, 4))
    rows = [r.asDict() for r in review.decision_records(matches, decisions, master, "id", "id" if master else "").collect()]
    label = "Master_ID" if master else "Duplicate_ID"
    assert [(r["Primary_ID"], r[label]) for r in rows] == [("0", "50"), ("1", "51"), ("2", "52")]
    assert [r["Final Selection"] for r in rows] == ["a0", "b1", ""]
    assert [r["Action"] for r in rows] == ["Kept Original", "Mapped to Master" if master else "Merged Duplicate", "Flagged for Review"]
    assert [r["Note"] for r in rows] == ["A0", "B1", "F2"]


def test_summary_pending_and_audit(spark, matches):
    replayed = review.in_range(review.replay_index(log(spark, {"s": "UABUF"})), 4)
    decisions = review.effective_decisions(replayed)
    assert [r["match_id"] for r in review.pending_matches(matches, decisions).orderBy("match_id").collect()] == [3, 4]
    assert tuple(report.review_summary(decisions, matches).first()) == (1, 1, 0, 2)
    lines = [r["line"] for r in review.audit_trail(matches, replayed).orderBy("seq").collect()]
    assert lines == [
        "DECISION [Keep A] #1 | Score=90.0 | A='a0' | B='b0' | Note='A1'",
        "DECISION [Override B] #2 | Score=89.0 | A='a1' | B='b1' | Note='B2'",
        "UNDO: reverted decision [B] at index 1",
        "DECISION [Flag] #2 | Score=89.0 | A='a1' | B='b1' | Note='F4'",
    ]


def test_eta(spark):
    replayed = review.replay_index(log(spark, {"a": "AB", "b": "AUU", "c": "ABSF"}))
    got = {r["session"]: (r["reviewed"], r["remaining"], r["eta"]) for r in report.review_eta(replayed, 30).collect()}
    # a: 10 s for 2, 28 left; c: 30 s for 4, 26 left
    assert got == {"a": (2, 28, "2m 20s"), "b": (0, 30, "–"), "c": (4, 26, "3m 15s")}
    assert {r["session"]: r["eta"] for r in report.review_eta(replayed, 8).collect()}["a"] == "30s"


def test_histogram(spark):
    scores = [50.0, 59.9, 60.0, 69.9, 70.0, 85.0, 90.0, 99.9, 100.0]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = report.histogram_scale(report.score_histogram(df)).collect()
    assert [(r["bucket"], r["n"]) for r in got] == [("50–60", 2), ("60–70", 2), ("70–80", 1), ("80–90", 1), ("90–100", 2), ("100", 1)]
    assert [r["share"] for r in got] == [1.0, 1.0, 0.5, 0.5, 1.0, 0.5]
    empty = report.histogram_scale(report.score_histogram(df.limit(0))).collect()
    assert [(r["n"], r["share"]) for r in empty] == [(0, 0.0)] * 6
