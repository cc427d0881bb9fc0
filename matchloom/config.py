"""Scan configuration: which columns are compared, how strictly, and against what."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# The accepted settings of a scan.
ENGINES = ("fuzzy", "tfidf")
MATCH_LIMITS = (1, 3, 5, 10, 20)
CUTOFF_MIN, CUTOFF_MAX = 50, 100
SAMPLE_ROWS = 100


@dataclass(frozen=True)
class ScanConfig:
    """One scan. ``mappings`` pairs primary with master columns and wins over the two lists."""

    primary_cols: tuple[str, ...]
    master_cols: tuple[str, ...] = ()
    mappings: tuple[tuple[str, str], ...] = ()
    engine: str = "fuzzy"
    cutoff: int = 85
    k: int = 5
    primary_id: str = ""
    master_id: str = ""
    sample: bool = False
    file: str = ""
    master_file: str = ""


def apply_mappings(cfg: ScanConfig) -> ScanConfig:
    """Column pairs, when given, replace the chosen columns on both sides, repeats included."""
    if not cfg.mappings:
        return cfg
    return replace(
        cfg,
        primary_cols=tuple(p for p, _ in cfg.mappings),
        master_cols=tuple(m for _, m in cfg.mappings),
    )


def _require_columns(df: DataFrame, names, side: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{side} table has no column {', '.join(missing)}")


def validate_config(df: DataFrame, master: DataFrame | None, cfg: ScanConfig) -> ScanConfig:
    """Check a scan against the tables it will read; returns it with the mappings applied."""
    if not cfg.primary_cols and not (master is not None and cfg.mappings):
        raise ValueError("choose at least one primary column")
    if cfg.engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    if cfg.k not in MATCH_LIMITS:
        raise ValueError(f"k must be one of {MATCH_LIMITS}")
    if int(cfg.cutoff) != cfg.cutoff or not CUTOFF_MIN <= cfg.cutoff <= CUTOFF_MAX:
        raise ValueError(f"cutoff must be a whole number from {CUTOFF_MIN} to {CUTOFF_MAX}")
    if master is None:
        cfg = replace(cfg, mappings=(), master_cols=(), master_id="")
    else:
        cfg = apply_mappings(cfg)
        if not cfg.master_cols:
            raise ValueError("a master table needs a column mapping or at least one master column")
        _require_columns(master, cfg.master_cols, "master")
        _require_columns(master, [cfg.master_id] if cfg.master_id else [], "master")
    _require_columns(df, cfg.primary_cols, "primary")
    _require_columns(df, [cfg.primary_id] if cfg.primary_id else [], "primary")
    return cfg


def scan_prefix(master_mode: bool) -> dict[str, str]:
    """The labels that depend on the mode."""
    # Labels of columns, files and actions.
    if master_mode:
        return {
            "mode": "master",
            "scan": "Master_Scan",
            "final": "Final_Master_Mapping",
            "other_id": "Master_ID",
            "override": "Mapped to Master",
        }
    return {
        "mode": "dedupe",
        "scan": "Dedupe_Scan",
        "final": "Final_Internal_Dedupe",
        "other_id": "Duplicate_ID",
        "override": "Merged Duplicate",
    }
