"""Reading tables and writing results."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.config import ScanConfig, scan_prefix
from matchloom.functions.text import ref
from matchloom.operators.matches import match_export
from matchloom.operators.review import approved, flagged
from matchloom.plans.scratch import materialise
from matchloom.sources.records import read_records, spanning_states

# Cell texts that read as missing in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts that read as true or false, and the shapes of numbers.
TRUE_TOKENS, FALSE_TOKENS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf|[iI]nfinity)\s*$"


def normalise_missing(df: DataFrame) -> DataFrame:
    """Text cells that stand for a missing value become NULL."""
    out = [
        F.when(~ref(f.name).isin(*MISSING_TOKENS), ref(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else ref(f.name)
        for f in df.schema
    ]
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint, double or boolean where every present cell fits. One pass over the data."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    checks = []
    for i, n in enumerate(names):
        c = ref(n)
        checks += [
            F.count(c).alias(f"present{i}"),
            F.count_if(c.rlike(WHOLE_PATTERN) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            F.count_if(c.rlike(NUMBER_PATTERN)).alias(f"number{i}"),
            F.count_if(c.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"truth{i}"),
        ]
    if not checks:
        return df
    seen = df.agg(*checks).first()
    cast = {}
    for i, n in enumerate(names):
        present = seen[f"present{i}"]
        if not present:
            continue
        if seen[f"whole{i}"] == present:
            cast[n] = F.trim(ref(n)).cast("bigint")
        elif seen[f"number{i}"] == present:
            cast[n] = F.trim(ref(n)).cast("double")
        elif seen[f"truth{i}"] == present:
            cast[n] = ref(n).isin(*TRUE_TOKENS)
    return df.select(*[cast[n].alias(n) if n in cast else ref(n) for n in df.columns])


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool | None = None) -> DataFrame:
    """A delimited file with a header, types inferred, or a Parquet table.

    Large files are split, also where a cell holds a line break: one splittable pass finds out whether any does, and
    then records are put together range by range. ``multiline`` skips that pass: False takes every line as a record,
    True reads each file in one task.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError("fmt must be csv or parquet")
    if multiline is None and (states := spanning_states(spark, path)) is not None:
        cells = read_records(spark, path, _csv(spark, path, True).columns, states)
        # types are inferred and cells read from the same assembled records
        return infer_types(normalise_missing(materialise(cells, "records")))
    return infer_types(normalise_missing(_csv(spark, path, bool(multiline))))


def read_columns(spark: SparkSession, path: str, fmt: str = "csv") -> list[str]:
    """Column names only; no rows are read."""
    return spark.read.parquet(path).columns if fmt == "parquet" else _csv(spark, path, False).columns


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def _write(df: DataFrame, path: str, fmt: str) -> str:
    writer = df.write
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
    return path


def export_matches(
    matches: DataFrame, folder: str, stem: str, master_mode: bool, fmt: str = "csv", now: datetime | None = None
) -> str:
    """Write the raw matches; returns the path."""
    path = f"{folder}/{scan_prefix(master_mode)['scan']}_{stem}_{stamp(now)}"
    return _write(match_export(matches), path, fmt)


def export_decisions(
    records: DataFrame, folder: str, stem: str, master_mode: bool, fmt: str = "csv", now: datetime | None = None
) -> dict[str, str]:
    """Write approved and flagged records apart, each only when there are any."""
    base = f"{folder}/{scan_prefix(master_mode)['final']}_{stem}_{stamp(now)}"
    out = {}
    for name, part in (("Decisions", approved(records)), ("Flagged for Review", flagged(records))):
        if not part.isEmpty():
            out[name] = _write(part, f"{base}/{name}", fmt)
    return out


def scan_settings(spark: SparkSession, cfg: ScanConfig, master_mode: bool) -> DataFrame:
    """The settings of a scan as one row."""
    c = asdict(cfg)
    row = (
        c["file"], c["master_file"], c["engine"], c["cutoff"], c["k"], scan_prefix(master_mode)["mode"],
        c["sample"], list(c["primary_cols"]), list(c["master_cols"]) if master_mode else [],
    )
    return spark.createDataFrame(
        [row],
        "file string, master_file string, engine string, cutoff int, max_limit int, mode string, "
        "test_mode boolean, primary_cols array<string>, master_cols array<string>",
    )
