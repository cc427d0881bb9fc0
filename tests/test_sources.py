from datetime import datetime

import pytest

from matchloom.config import ScanConfig
from matchloom.sources import session, tables

NOW = datetime(2024, 5, 6, 7, 8, 9)


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_table(spark, tmp_path):
    path = write(
        tmp_path,
        'id,name,size,ok,mixed,code\n1,"He said ""hi"", ok",1.5,True,1,007\n2,NA,,false,x,8\n3,"two\nlines",n/a,,,\n',
    )
    df = tables.read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "size": "double", "ok": "boolean", "mixed": "string", "code": "bigint"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 'He said "hi", ok', 1.5, True, "1", 7),
        (2, None, None, False, "x", 8),
        (3, "two\nlines", None, None, None, None),
    ]


def test_missing_tokens(spark):
    df = spark.createDataFrame([(t,) for t in [*tables.MISSING_TOKENS, "na", "x", "NONE"]], "v string")
    assert [r["v"] for r in tables.normalise_missing(df).filter("v is not null").collect()] == ["na", "x", "NONE"]


def test_whole_numbers_too_large_stay_numbers_of_another_kind(spark, tmp_path):
    df = tables.read_table(spark, write(tmp_path, "v\n9223372036854775808\n1\n"))
    assert df.dtypes == [("v", "double")]


def test_read_columns(spark, tmp_path):
    assert tables.read_columns(spark, write(tmp_path, "b,a\n1,2\n")) == ["b", "a"]


@pytest.fixture
def matches(spark):
    return spark.createDataFrame(
        [(2, 85.0, "c", "d", (3, "c"), (4, "d")), (1, 90.0, 'a, "x"', "b", (1, 'a, "x"'), (2, "b"))],
        "match_id long, score double, match_a string, match_b string, "
        "row_a struct<id:long,name:string>, row_b struct<id:long,name:string>",
    )


def test_export_matches(spark, tmp_path, matches):
    path = tables.export_matches(matches, str(tmp_path), "vendors", True, now=NOW)
    assert path.endswith("/Master_Scan_vendors_20240506_070809")
    back = tables.read_table(spark, path)
    assert back.columns == ["Score (%)", "Primary Item", "Matched Item", "A_id", "A_name", "B_id", "B_name"]
    assert tuple(back.orderBy("A_id").first()) == (90.0, 'a, "x"', "b", 1, 'a, "x"', 2, "b")


def test_export_decisions_skips_empty_outputs(spark, tmp_path):
    schema = "Primary_ID string, Action string"
    only = spark.createDataFrame([("1", "Kept Original")], schema)
    files = tables.export_decisions(only, str(tmp_path), "v", False, now=NOW)
    assert list(files) == ["Decisions"] and "Final_Internal_Dedupe_v_20240506_070809" in files["Decisions"]
    assert tables.export_decisions(only.limit(0), str(tmp_path), "w", True, now=NOW) == {}


def test_session_round_trip(spark, tmp_path, matches):
    path = str(tmp_path / "session")
    session.save_session(path, matches, True, [("a", "b")], "id", "mid", "/x")
    events = spark.createDataFrame([("s", 1, NOW, "A", "n")], session.EVENT_SCHEMA)
    session.append_events(path, events)
    session.append_events(path, events.selectExpr("session", "seq + 1 AS seq", "ts", "'U' AS choice", "note"))
    got = session.load_session(spark, path)
    assert got.matches.count() == 2 and [r["choice"] for r in got.events.orderBy("seq").collect()] == ["A", "U"]
    assert (got.is_master_mode, got.col_mappings, got.primary_id, got.master_id) == (True, (("a", "b"),), "id", "mid")
    session.finish_session(spark, path)
    assert session.load_session(spark, path).finished


def test_old_session_takes_defaults(spark, tmp_path, matches):
    path = str(tmp_path / "session")
    session.save_session(path, matches)
    spark.createDataFrame([("id",)], "primary_id string").write.mode("overwrite").parquet(f"{path}/session")
    got = session.load_session(spark, path)
    assert (got.is_master_mode, got.col_mappings, got.primary_id, got.master_id, got.finished) == (False, (), "id", "", False)


def test_scan_settings(spark):
    cfg = ScanConfig(primary_cols=("a",), master_cols=("b",), engine="tfidf", file="f.csv")
    row = tables.scan_settings(spark, cfg, True).first()
    assert (row["mode"], row["engine"], row["cutoff"], row["max_limit"], row["master_cols"]) == ("master", "tfidf", 85, 5, ["b"])
    assert tables.scan_settings(spark, cfg, False).first()["master_cols"] == []
