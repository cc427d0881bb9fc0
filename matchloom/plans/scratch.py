"""Intermediate tables that several later stages read.

They are written as Parquet under the shared folder of ``spark.checkpoint.dir``: lineage is cut, a
lost executor costs only its running tasks, and later reads prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local: list[str] = []
_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_owner: ContextVar[list[str] | None] = ContextVar("scratch_owner", default=None)


def scratch_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="matchloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    mine = _owner.get()
    (_written if mine is None else mine).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables written outside any scope. Results not yet saved elsewhere become unreadable."""
    _delete(spark, _written)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables written inside: they go when the block ends, on success and on failure.

    Results must be saved elsewhere before that. Scopes of other threads, and the tables outside, stay.
    """
    mine: list[str] = []
    token = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(token)
        _delete(spark, mine)


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is written inside; the session's own comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write once, read back. The shuffles behind the table are deleted once it is written.

    ``batch_rows``: so many rows at most go to a Python worker at once, where they are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    most = int(spark.conf.get(_BATCH_ROWS))
    wanted = most if batch_rows is None else batch_rows if most <= 0 else min(batch_rows, most)
    # what is written inside leaves no shuffle files behind
    with _with_setting(spark, _CLEANUP, "true"), _with_setting(spark, _BATCH_ROWS, str(wanted)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, label: str, batch_rows: int | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write once, read back, and return aggregates observed during the write instead of a second pass."""
    seen = Observation()
    stored = materialise(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), label, batch_rows)
    return stored, seen.get
