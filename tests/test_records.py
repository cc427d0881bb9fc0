"""Records that span lines, in files cut into many byte ranges, against Python's csv module."""

import csv
import io
import random

import pytest

from matchloom.sources import records, tables


def cells(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice(['"', "\n", ",", "x", "y ", '""']) for _ in range(rng.randrange(1, 30)))
    if kind < 0.33:
        return "long\n" * rng.randrange(20, 400)
    return rng.choice(["plain", "two words", "7 in", "a,b", "é"])


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    spark.conf.set(names[2], "40")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_against_a_plain_reader(spark, tmp_path, small_ranges, seed, end):
    rng = random.Random(seed)
    rows = [[f"r{i}", cells(rng), cells(rng)] for i in range(150)]
    for part in (0, 1):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "the name", "b.c"])
        writer.writerows(rows[part::2])
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    states = records.spanning_states(spark, str(tmp_path))
    assert states, "some range should start inside a cell"
    back = records.read_records(spark, str(tmp_path), ["id", "the name", "b.c"], states)
    got = sorted(tuple(r) for r in back.collect())
    # a cell of line breaks only reads as empty on both sides
    assert got == sorted(tuple(c or None for c in r) for r in rows)
    pieces = records._lines(spark, str(tmp_path)).mapInArrow(records._assemble(states), records._PIECES)
    assert pieces.rdd.getNumPartitions() > 20
    table = tables.read_table(spark, str(tmp_path))
    assert table.columns == ["id", "the name", "b.c"] and table.count() == len(rows)


def test_stray_quotes_do_not_span(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,size\n1,7" pipe\n2,x"y"z"\n3,"quoted"\n')
    assert records.spanning_states(spark, str(path)) is None
    assert [tuple(r) for r in tables.read_table(spark, str(path)).orderBy("id").collect()] == [(1, '7" pipe'), (2, 'x"y"z"'), (3, "quoted")]


@pytest.mark.parametrize(
    "line, inside, expected",
    [("a,b", False, False), ('a,"b', False, True), ('b"', True, False), ('b""', True, True), ('b"",x"', True, False), ('a"b,c', False, False), ('"",""', False, False), ('"a""', False, True), ('x",y,"z', True, True), ("", True, True), ("", False, False)],
)
def test_states_of_lines(line, inside, expected):
    assert records.ends_inside(line, inside) is expected
