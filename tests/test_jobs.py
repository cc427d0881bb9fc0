import pytest

import matchloom
from matchloom import ScanConfig, validate_config
from matchloom.operators.keys import keyed, with_row_order
from matchloom.operators.matches import join_back
from matchloom.plans import scratch
from matchloom.sources import session

VENDOR = "vendor_id long, name string, city string, phone long, note string"


@pytest.fixture
def vendors(spark):
    return spark.createDataFrame(
        [
            (1, "Acme Steel", "Bonn", 1, "first"),
            (2, "Nord Trading", "Kiel", None, "other"),
            (3, "Acme Steels", "Bonn", 1, "near"),
            (4, "ACME, Steel", "Bonn", 1, "last"),  # same key as row 1
            (5, None, None, None, "blank"),
        ],
        VENDOR,
    )


@pytest.mark.parametrize("engine", ["fuzzy", "tfidf"])
def test_dedupe(vendors, engine):
    got = matchloom.dedupe(vendors, ["name", "city"], engine=engine, cutoff=60, order_col="vendor_id").collect()
    assert len(got) == 1
    m = got[0]
    # equal keys collapse: no pair of them; position of the first row, cells of the last
    assert (m["match_id"], m["pos_a"], m["pos_b"], m["rank"]) == (1, 1, 3, 1)
    assert m["row_a"]["vendor_id"] == 4 and m["match_a"] == "ACME, Steel | Bonn" and m["match_b"] == "Acme Steels | Bonn"
    assert m["row_a"].asDict()["note"] == "last"


def test_scan_order_without_an_order_column(vendors):
    got = matchloom.dedupe(vendors.coalesce(1), ["name", "city"], cutoff=60).collect()
    assert [(m["row_a"]["vendor_id"], m["row_b"]["vendor_id"]) for m in got] == [(4, 3)]


@pytest.fixture
def master(spark):
    return spark.createDataFrame(
        [("S1", "acme steel", "bonn"), ("S2", "steel acme", "bonn"), ("S3", "zzz", "kiel")],
        "supplier_id string, legal_name string, town string",
    ).selectExpr("*", "cast(substr(supplier_id, 2) AS int) AS n")


@pytest.mark.parametrize("engine, first", [("fuzzy", "S1"), ("tfidf", "S2")])
def test_map_to_master(vendors, master, engine, first):
    got = matchloom.map_to_master(
        vendors, master, [("name", "legal_name"), ("city", "town")], engine=engine, cutoff=70,
        order_col="vendor_id", master_order_col="n",
    ).collect()
    top = [m for m in got if m["pos_a"] == 1]
    # an equal key scores 100; so does the reordered one, and the engine decides the order
    assert [m["score"] for m in top] == [100.0, 100.0] and top[0]["row_b"]["supplier_id"] == first
    assert [m["match_id"] for m in got] == list(range(1, len(got) + 1))


def test_sample_takes_the_first_hundred_primary_rows(spark):
    df = spark.range(150).selectExpr("149 - id AS id", "concat('name ', 149 - id) AS name")
    got = matchloom.map_to_master(df, df, [("name", "name")], cutoff=100, sample=True, order_col="id", master_order_col="id")
    assert got.count() == 100 and got.agg({"pos_a": "max"}).first()[0] == 99


def test_final_order(spark):
    rows = [(0, "abcdefghij"), (1, "zzzzyyyyxx"), (2, "abcdefghik"), (3, "zzzzyyyyxxw"), (4, "abcdefghijk")]
    df = spark.createDataFrame(rows, "id long, name string")
    got = matchloom.dedupe(df, ["name"], cutoff=80, order_col="id").collect()
    # falling score, then position of the item, then rank
    assert [(m["pos_a"], m["pos_b"], m["score"]) for m in got] == [(0, 4, 95.2), (1, 3, 95.2), (2, 4, 95.2), (0, 2, 90.0)]


def test_nothing_to_match(vendors):
    assert matchloom.dedupe(vendors.limit(0), ["name"], order_col="vendor_id").count() == 0
    assert matchloom.dedupe(vendors.filter("vendor_id = 5"), ["name"], engine="tfidf", order_col="vendor_id").count() == 0


def test_review_resume_and_join_back(spark, vendors, master, tmp_path):
    found = matchloom.map_to_master(
        vendors, master, [("name", "legal_name")], cutoff=60, order_col="vendor_id", master_order_col="n"
    )
    path = str(tmp_path / "session")
    session.save_session(path, found, True, [("name", "legal_name")], "vendor_id", "supplier_id")
    events = spark.sql(
        "SELECT 's' AS session, id AS seq, timestamp_seconds(id) AS ts, element_at(array('A','U','B'), cast(id + 1 AS int)) AS choice, ' ok ' AS note FROM range(3)"
    )
    session.append_events(path, events)
    at = matchloom.resume(spark, path)
    assert at.master_mode and at.pending.count() == found.count() - 1
    done = matchloom.review(found, events, True, "vendor_id", "supplier_id", folder=str(tmp_path), stem="v")
    assert list(done.files) == ["Decisions"]
    record = done.records.first()
    assert record["Action"] == "Mapped to Master" and record["Note"] == "ok" and record["Master_ID"].startswith("S")
    joined = join_back(vendors, done.records, "vendor_id")
    assert joined.count() == 5 and joined.filter("Action IS NOT NULL").count() == 1


@pytest.mark.parametrize(
    "change, message",
    [
        ({"primary_cols": ()}, "at least one"),
        ({"primary_cols": ("nope",)}, "no column"),
        ({"engine": "other"}, "engine"),
        ({"k": 2}, "k must"),
        ({"cutoff": 49}, "cutoff"),
        ({"cutoff": 101}, "cutoff"),
        ({"primary_id": "nope"}, "no column"),
    ],
)
def test_bad_settings(vendors, change, message):
    with pytest.raises(ValueError, match=message):
        validate_config(vendors, None, ScanConfig(**{"primary_cols": ("name",), **change}))


def test_master_settings(vendors, master):
    with pytest.raises(ValueError, match="master"):
        validate_config(vendors, master, ScanConfig(primary_cols=("name",)))
    cfg = validate_config(
        vendors, master, ScanConfig(primary_cols=("name",), master_cols=("town",), mappings=(("city", "town"), ("city", "legal_name")))
    )
    assert cfg.primary_cols == ("city", "city") and cfg.master_cols == ("town", "legal_name")
    plain = validate_config(vendors, master, ScanConfig(primary_cols=("name",), master_cols=("town",)))
    assert plain.master_cols == ("town",)


def test_reserved_and_odd_names(spark):
    df = spark.createDataFrame([(1, "x")], "id long, __key string")
    with pytest.raises(ValueError, match="reserved"):
        with_row_order(df)
    odd = spark.createDataFrame([(1, "a b")], ["id", "full.name"])
    assert keyed(odd, ["full.name"], "id").first()["__key"] == "a b"


def test_clear_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(scratch, "_written", [])
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab ce")], "id long, name string")
    assert matchloom.dedupe(df, ["name"], cutoff=50, order_col="id").count() == 1
    assert any(tmp_path.iterdir())
    matchloom.clear_scratch(spark)
    assert not any(tmp_path.iterdir())


def test_scratch_scope(spark, tmp_path, monkeypatch):
    """Tables of a scope go with it, also after an error; those of another stay readable."""
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(scratch, "_written", [])
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab ce")], "id long, name string")
    outer = matchloom.dedupe(df, ["name"], cutoff=50, order_col="id")
    before = set(tmp_path.iterdir())
    with pytest.raises(RuntimeError), matchloom.scratch_scope(spark):
        assert matchloom.dedupe(df, ["name"], cutoff=50, order_col="id").count() == 1
        assert set(tmp_path.iterdir()) > before
        raise RuntimeError
    assert set(tmp_path.iterdir()) == before and outer.count() == 1


@pytest.mark.parametrize("ids, what", [((1, 1, 2), "repeated"), ((1, None, 2), "missing")])
def test_order_column_must_be_unique(spark, ids, what):
    df = spark.createDataFrame([(i, f"name {n}") for n, i in enumerate(ids)], "id long, name string")
    for make in (lambda: matchloom.dedupe(df, ["name"], order_col="id"), lambda: matchloom.map_to_master(df, df, cols=["name"], master_cols=["name"], master_order_col="id")):
        with pytest.raises(ValueError, match=what):
            make()


def test_negative_order_column(spark):
    df = spark.createDataFrame([(-5, "acme steel works"), (-2, "acme steel work"), (7, "bravo trading")], "id long, name string")
    got = matchloom.dedupe(df, ["name"], order_col="id").collect()
    assert [(r["pos_a"], r["pos_b"]) for r in got] == [(-5, -2)]


def test_several_sessions(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab ce")], "id long, name string")
    found = matchloom.dedupe(df, ["name"], cutoff=50, order_col="id")
    events = spark.sql("SELECT s AS session, 1L AS seq, timestamp_seconds(0) AS ts, c AS choice, '' AS note FROM VALUES ('x', 'A'), ('y', 'B') AS t(s, c)")
    with pytest.raises(ValueError, match="several sessions"):
        matchloom.review(found, events, False)
    for name, action in (("x", "Kept Original"), ("y", "Merged Duplicate")):
        done = matchloom.review(found, events, False, session=name)
        assert [r["Action"] for r in done.records.collect()] == [action]
        assert tuple(done.summary.first()) == (1, 0, 0, 0)
    with pytest.raises(ValueError, match="seq"):
        matchloom.review(found, events.unionAll(events), False, session="x")


def test_finished_session(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab ce")], "id long, name string")
    path = str(tmp_path / "s")
    session.save_session(path, matchloom.dedupe(df, ["name"], cutoff=50, order_col="id"))
    s = session.load_session(spark, path)
    none = s.events
    matchloom.review(s.matches, none, False, session_path=path)
    assert matchloom.resume(spark, path).pending.count() == 1
    events = spark.sql("SELECT 'x' AS session, 1L AS seq, timestamp_seconds(0) AS ts, 'A' AS choice, '' AS note")
    matchloom.review(s.matches, events, False, session_path=path)
    with pytest.raises(ValueError, match="finished"):
        matchloom.resume(spark, path)


def test_scan_leaves_its_products(spark, tmp_path):
    from datetime import datetime

    from matchloom import run_scan
    from matchloom.config import ScanConfig
    from matchloom.sources import session, tables

    rows = [(1, "acme steel"), (2, "acme steel "), (3, "acme steal"), (4, "other")]
    df = spark.createDataFrame(rows, "id long, name string")
    made = run_scan(df, ScanConfig(primary_cols=("name",), primary_id="id", engine="fuzzy", cutoff=80), str(tmp_path), order_col="id", stem="firms", now=datetime(2024, 5, 6, 7, 8, 9))
    assert tuple(made.metrics.first()) == (3, 0, 1)
    assert made.export.endswith("/Dedupe_Scan_firms_20240506_070809") and tables.read_table(spark, made.export).count() == 1
    kept = session.load_session(spark, made.session)
    assert (kept.primary_id, kept.raw_export_path, kept.finished, kept.version) == ("id", made.export, False, 1)
    assert kept.matches.collect() == made.matches.collect()
    assert spark.read.parquet(made.settings).first()["cutoff"] == 80
    session.finish_session(spark, made.session)
    again = session.load_session(spark, made.session)
    assert again.finished and again.version == 2 and spark.read.parquet(f"{made.session}/session").count() == 2


def test_lost_writer_leaves_the_session(spark, tmp_path, monkeypatch):
    """Settings are only ever added: a writer that fails between its steps loses nothing."""
    from matchloom.sources import session

    df = spark.createDataFrame([(1, 90.0)], "match_id long, score double")
    session.save_session(f"{tmp_path}/s", df, primary_id="id")

    def lost(spark, path, row, mode):
        raise RuntimeError("lost")

    monkeypatch.setattr(session, "_add_version", lost)
    with pytest.raises(RuntimeError):
        session.finish_session(spark, f"{tmp_path}/s")
    kept = session.load_session(spark, f"{tmp_path}/s")
    assert (kept.primary_id, kept.finished) == ("id", False) and kept.matches.count() == 1
