"""A review session as tables: the matches, an append-only event log, and versions of one row of settings.

Nothing is ever overwritten: a change adds a version of the settings, and the last one counts. So a writer that is
lost at any point leaves the session as it was before."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "session string, seq bigint, ts timestamp, choice string, note string"
META_SCHEMA = (
    "is_master_mode boolean, col_mappings array<struct<primary:string,master:string>>, "
    "primary_id string, master_id string, raw_export_path string, finished boolean, version bigint"
)


@dataclass(frozen=True)
class Session:
    matches: DataFrame
    events: DataFrame
    is_master_mode: bool
    col_mappings: tuple[tuple[str, str], ...]
    primary_id: str
    master_id: str
    raw_export_path: str | None
    finished: bool
    version: int = 0


def save_session(
    path: str,
    matches: DataFrame,
    master_mode: bool = False,
    mappings: Sequence[tuple[str, str]] = (),
    primary_id: str = "",
    master_id: str = "",
    raw_export_path: str | None = None,
) -> None:
    """Start a session: matches, an empty log and the first version of the settings."""
    spark = matches.sparkSession
    matches.write.parquet(f"{path}/matches")
    spark.createDataFrame([], EVENT_SCHEMA).write.parquet(f"{path}/events")
    _add_version(spark, path, (master_mode, [tuple(m) for m in mappings], primary_id, master_id, raw_export_path, False, 1), "errorifexists")


def _add_version(spark: SparkSession, path: str, row: tuple, mode: str) -> None:
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/session")


def append_events(path: str, events: DataFrame) -> None:
    """Autosave: new decisions are only ever added."""
    events.select("session", "seq", "ts", "choice", "note").write.mode("append").parquet(f"{path}/events")


def load_session(spark: SparkSession, path: str) -> Session:
    """Read a session back; settings that an older session lacks take their defaults."""
    meta = (
        spark.read.schema(META_SCHEMA)
        .parquet(f"{path}/session")
        .select(
            F.coalesce("is_master_mode", F.lit(False)).alias("is_master_mode"),
            "col_mappings",
            F.coalesce("primary_id", F.lit("")).alias("primary_id"),
            F.coalesce("master_id", F.lit("")).alias("master_id"),
            "raw_export_path",
            F.coalesce("finished", F.lit(False)).alias("finished"),
            F.coalesce("version", F.lit(0)).alias("version"),
        )
        # two writers may have added the same version: a finished one counts
        .orderBy(F.desc("version"), F.desc("finished"))
        .first()
    )
    return Session(
        matches=spark.read.parquet(f"{path}/matches"),
        events=spark.read.schema(EVENT_SCHEMA).parquet(f"{path}/events"),
        is_master_mode=meta["is_master_mode"],
        col_mappings=tuple((m["primary"], m["master"]) for m in meta["col_mappings"] or ()),
        primary_id=meta["primary_id"],
        master_id=meta["master_id"],
        raw_export_path=meta["raw_export_path"],
        finished=meta["finished"],
        version=meta["version"],
    )


def finish_session(spark: SparkSession, path: str) -> None:
    """Mark a session as done, so that it is not resumed."""
    s = load_session(spark, path)
    row = (s.is_master_mode, list(s.col_mappings), s.primary_id, s.master_id, s.raw_export_path, True, s.version + 1)
    _add_version(spark, path, row, "append")
