"""End-to-end jobs: scan one table, map a table to a master, apply a review, resume one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import SAMPLE_ROWS, ScanConfig, validate_config
from matchloom.operators.fuzzy import fuzzy_join, fuzzy_self_join
from matchloom.operators.keys import catalogue, check_row_order, key_spans, keyed, rows_for, with_row_order
from matchloom.operators.matches import attach_rows, build_matches, rank_matches
from matchloom.operators.report import review_summary
from matchloom.operators.review import decision_records, effective_decisions, in_range, one_session, pending_matches, replay_index
from matchloom.operators.tfidf import tfidf_join, tfidf_self_join
from matchloom.plans.scratch import materialise, materialise_counted
from matchloom.plans.ship import ship
from matchloom.sources.session import finish_session, load_session, save_session
from matchloom.sources.tables import export_decisions, export_matches, scan_settings, stamp

_SELF = {"fuzzy": fuzzy_self_join, "tfidf": tfidf_self_join}
_TWO_SIDED = {"fuzzy": fuzzy_join, "tfidf": tfidf_join}


def scan(
    df: DataFrame,
    cfg: ScanConfig,
    master: DataFrame | None = None,
    order_col: str | None = None,
    master_order_col: str | None = None,
) -> DataFrame:
    """Run one scan; a master table selects the mode. Returns the numbered matches."""
    return _scan(df, validate_config(df, master, cfg), master, order_col, master_order_col)[0]


def _scan(
    df: DataFrame, cfg: ScanConfig, master: DataFrame | None, order_col: str | None, master_order_col: str | None
) -> tuple[DataFrame, int, int]:
    """The matches, and the numbers of distinct keys on both sides (0 without a master)."""
    ship(df.sparkSession)
    sample = SAMPLE_ROWS if cfg.sample else None
    mine = _Side(df, cfg.primary_cols, order_col, sample)
    if master is None:
        theirs, cols_b = mine, cfg.primary_cols
        pairs = _SELF[cfg.engine](mine.keys(), cfg.cutoff, cfg.k)
    else:
        theirs, cols_b = _Side(master, cfg.master_cols, master_order_col), cfg.master_cols
        pairs = _TWO_SIDED[cfg.engine](mine.keys(), theirs.keys(), cfg.cutoff, cfg.k)
    pairs = materialise(pairs, "pairs")
    wanted_a, wanted_b = pairs.select(F.col("pos_a").alias("pos")), pairs.select(F.col("pos_b").alias("pos"))
    if master is None:
        lookup_a = lookup_b = mine.rows(wanted_a.unionAll(wanted_b))
    else:
        lookup_a, lookup_b = mine.rows(wanted_a), theirs.rows(wanted_b)
    matches = rank_matches(build_matches(attach_rows(pairs, lookup_a, lookup_b), cfg.primary_cols, cols_b))
    return matches, mine.n, 0 if master is None else theirs.n


@dataclass(frozen=True)
class ScanProducts:
    """What a scan leaves: its matches and metrics, and the paths of its settings, raw matches and review session."""

    matches: DataFrame
    metrics: DataFrame
    settings: str
    export: str
    session: str


def run_scan(
    df: DataFrame,
    cfg: ScanConfig,
    folder: str,
    master: DataFrame | None = None,
    order_col: str | None = None,
    master_order_col: str | None = None,
    stem: str = "table",
    fmt: str = "csv",
    now: datetime | None = None,
) -> ScanProducts:
    """Run one scan and leave its products in a folder: settings, all matches, and a session to be reviewed.

    The metrics are counted while keys and matches are written; nothing is joined or read a second time.
    """
    cfg = validate_config(df, master, cfg)
    spark, mode, now = df.sparkSession, master is not None, now or datetime.now()
    settings = f"{folder}/Settings_{stem}_{stamp(now)}"
    scan_settings(spark, cfg, mode).coalesce(1).write.parquet(settings)
    found, n_primary, n_master = _scan(df, cfg, master, order_col, master_order_col)
    matches, seen = materialise_counted(found, "matches", n=F.count(F.lit(1)))
    export = export_matches(matches, folder, stem, mode, fmt, now)
    session = f"{folder}/Session_{stem}_{stamp(now)}"
    save_session(session, matches, mode, cfg.mappings, cfg.primary_id, cfg.master_id, export)
    metrics = spark.createDataFrame([(n_primary, n_master, seen["n"])], "unique_primary long, unique_master long, n_matches long")
    return ScanProducts(matches, metrics, settings, export, session)


class _Side:
    """One input of a scan: its distinct keys, stored once, and the rows to show for some of them."""

    def __init__(self, df: DataFrame, cols: Sequence[str], order_col: str | None, sample: int | None = None):
        self.ordered = with_row_order(df, order_col)
        # positions from a column mean the same in every scan; positions from the scan order do not, so
        # then the rows are stored along with the keys
        self.fixed = order_col is not None
        if self.fixed:
            check_row_order(self.ordered)
        source = keyed(df, cols, order_col, sample)
        self.stored, seen = materialise_counted((key_spans if self.fixed else catalogue)(source), "keys", n=F.count(F.lit(1)))
        self.n: int = seen["n"]

    def keys(self) -> DataFrame:
        return self.stored.select("key", "pos")

    def rows(self, wanted: DataFrame) -> DataFrame:
        if self.fixed:
            return rows_for(self.ordered, self.stored, wanted)
        return self.stored.join(wanted, "pos", "left_semi").select("pos", "row")


def dedupe(
    df: DataFrame,
    cols: Sequence[str],
    engine: str = "fuzzy",
    cutoff: int = 85,
    k: int = 5,
    id_col: str | None = None,
    sample: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """Near-duplicates inside one table."""
    cfg = ScanConfig(
        primary_cols=tuple(cols), engine=engine, cutoff=cutoff, k=k, primary_id=id_col or "", sample=sample
    )
    return scan(df, cfg, order_col=order_col)


def map_to_master(
    df: DataFrame,
    master: DataFrame,
    mappings: Sequence[tuple[str, str]] = (),
    cols: Sequence[str] = (),
    master_cols: Sequence[str] = (),
    engine: str = "fuzzy",
    cutoff: int = 85,
    k: int = 5,
    id_col: str | None = None,
    master_id_col: str | None = None,
    sample: bool = False,
    order_col: str | None = None,
    master_order_col: str | None = None,
) -> DataFrame:
    """The best master rows for every row of a table."""
    cfg = ScanConfig(
        primary_cols=tuple(cols),
        master_cols=tuple(master_cols),
        mappings=tuple(tuple(m) for m in mappings),
        engine=engine,
        cutoff=cutoff,
        k=k,
        primary_id=id_col or "",
        master_id=master_id_col or "",
        sample=sample,
    )
    return scan(df, cfg, master, order_col, master_order_col)


@dataclass(frozen=True)
class Review:
    """``decisions``: the effective choice per match; ``records``: the output rows; ``files``: what was written."""

    decisions: DataFrame
    records: DataFrame
    summary: DataFrame
    files: dict[str, str]


def review(
    matches: DataFrame,
    events: DataFrame,
    master_mode: bool,
    primary_id: str = "",
    master_id: str = "",
    folder: str | None = None,
    stem: str = "table",
    fmt: str = "csv",
    session: str | None = None,
    session_path: str | None = None,
) -> Review:
    """Apply one session's log to the matches; with a folder, write the outcome.

    A log of several sessions needs ``session`` to name one of them. With the path of a stored session, that
    session is marked as finished once no match is pending.
    """
    events = one_session(events, session)
    replayed = in_range(replay_index(events), matches.count())
    decisions = materialise(effective_decisions(replayed).drop("session"), "decisions")
    records = decision_records(matches, decisions, master_mode, primary_id, master_id)
    files = export_decisions(records, folder, stem, master_mode, fmt) if folder else {}
    if session_path and pending_matches(matches, decisions).isEmpty():
        finish_session(matches.sparkSession, session_path)
    return Review(decisions, records, review_summary(decisions, matches), files)


@dataclass(frozen=True)
class Resumed:
    """Where a stored session stands: ``pending`` are the matches still to decide, in order."""

    review: Review
    pending: DataFrame
    master_mode: bool


def resume(spark: SparkSession, path: str) -> Resumed:
    """Pick up a stored session. A finished one is not resumed."""
    s = load_session(spark, path)
    if s.finished:
        raise ValueError(f"the review session is finished: {path}")
    done = review(s.matches, s.events, s.is_master_mode, s.primary_id, s.master_id)
    pending = pending_matches(s.matches, done.decisions).orderBy(F.col("match_id"))
    return Resumed(done, pending, s.is_master_mode)
