"""Delimited files whose records may span lines, read in as many tasks as Spark cuts the files into.

Whether a line break ends a record depends on all that comes before it: it does not inside a quoted cell. But a byte
range can tell, for either state at its start, in which state it ends. One pass finds that for each range, a fold over
a file's ranges gives the true states, and a second pass puts lines together. A record that runs into the next ranges
is the only thing that moves: its pieces, one for each range, meet by where it began.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.plans.scratch import materialise_counted

QUOTE, COMMA = '"', ","
_RANGE = "file string, at long, out_ends_in boolean, in_ends_in boolean, in_closes boolean, spans boolean"
_STATE = "file string, at long, inside boolean, owner long"
_PIECES = "file string, owner long, at long, first boolean, whole boolean, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. A quote opens a cell only as its first character; two stand for one."""
    at = 0
    while True:
        if inside:
            end = line.find(QUOTE, at)
            while end >= 0 and line[end + 1 : end + 2] == QUOTE:
                end = line.find(QUOTE, end + 2)
            if end < 0:
                return True
            inside, at = False, line.find(COMMA, end + 1) + 1
            if not at:
                return False
        if line[at : at + 1] == QUOTE:
            inside, at = True, at + 1
            continue
        at = line.find(COMMA, at) + 1
        if not at:
            return False


@dataclass
class _Range:
    """One byte range, as seen from either state at its start."""

    file: str
    at: int
    from_out: bool = False
    from_in: bool = True
    closes: bool = False
    spans: bool = False

    def add(self, line: str) -> None:
        if QUOTE in line:
            self.from_out = ends_inside(line, self.from_out)
            self.from_in = ends_inside(line, self.from_in)
        self.spans |= self.from_out
        self.closes |= not self.from_in

    def row(self) -> tuple:
        return self.file, self.at, self.from_out, self.from_in, self.closes, self.spans


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for file, at, line in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.at != at or now.file != file:
                if now:
                    done.append(now.row())
                now = _Range(file, at)
            now.add(line)
    yield _batch([*done, *([now.row()] if now else [])], _RANGE)


def _fold(table: pa.Table) -> pa.Table:
    """The ranges of one file in order: the state at the start of each, and the range where its first record began."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    inside, owner, out = False, -1, []
    for r in rows:
        out.append((r["file"], r["at"], inside, owner))
        if not inside or r["in_closes"]:
            owner = r["at"]
        inside = r["in_ends_in"] if inside else r["out_ends_in"]
    return pa.Table.from_batches([_batch(out, _STATE)])


def _assemble(states: dict[tuple[str, int], int]):
    """Whole records, and the pieces of those that a range does not hold whole. ``states``: ranges that start inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner, inside, first, held, rows = None, -1, False, False, [], []

        def record(whole: bool) -> tuple:
            text = "\n".join(held)
            return key[0], owner, key[1], first, whole, text

        for batch in batches:
            for file, at, line in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (file, at):
                    if held:
                        # the record goes on in the next range, or the file ends inside a quoted cell
                        rows.append(record(False))
                    key, held = (file, at), []
                    inside = key in states
                    owner = states.get(key, at)
                    first = not inside and at == 0
                held.append(line)
                inside = ends_inside(line, inside) if inside or QUOTE in line else False
                if not inside:
                    # the end of a record that began elsewhere is a piece, too
                    rows.append(record(owner == at))
                    held, owner, first = [], at, False
            if len(rows) >= 20_000:
                yield _batch(rows, _PIECES)
                rows = []
        if held:
            rows.append(record(False))
        yield _batch(rows, _PIECES)

    return run


def spanning_states(spark: SparkSession, path: str) -> dict[tuple[str, int], int] | None:
    """Ranges that start inside a cell, with the range where that record began; None if no record spans lines.

    At most one entry for each byte range of the input, of which Spark's driver holds the list as well.
    """
    scanned = _lines(spark, path).mapInArrow(_scan, _RANGE)
    ranges, seen = materialise_counted(scanned, "byte-ranges", spans=F.count_if("spans"))
    if not seen["spans"]:
        return None
    found = ranges.groupBy("file").applyInArrow(_fold, _STATE).filter("inside")
    return {(r["file"], r["at"]): r["owner"] for r in found.collect()}


def records(spark: SparkSession, path: str, states: dict[tuple[str, int], int]) -> DataFrame:
    """``record``: the text of every record but each file's first, the header; blank ones are left out."""
    pieces = _lines(spark, path).mapInArrow(_assemble(states), _PIECES)
    whole = pieces.filter("whole").select("first", "record")
    cut = F.sort_array(F.collect_list(F.struct("at", "record")))
    joined = pieces.filter("NOT whole").groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_join(F.transform(cut, lambda p: p["record"]), "\n").alias("record"))
    both = whole.unionAll(joined.select("first", "record")).filter("NOT first")
    return both.select(F.regexp_replace("record", "\r$", "").alias("record")).filter(F.trim("record") != "")


def read_records(spark: SparkSession, path: str, names: list[str], states: dict[tuple[str, int], int]) -> DataFrame:
    """The cells of all records as text columns."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("record", schema, {"escape": QUOTE, "multiLine": "true"})
    return records(spark, path, states).select(cells.alias("cells")).select([F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])
