"""matchloom: fuzzy record linkage on Spark DataFrames."""

from matchloom.config import ScanConfig, apply_mappings, scan_prefix, validate_config
from matchloom.plans.jobs import dedupe, map_to_master, resume, review, run_scan
from matchloom.plans.scratch import clear_scratch, scratch_scope

__all__ = [
    "ScanConfig",
    "apply_mappings",
    "clear_scratch",
    "dedupe",
    "map_to_master",
    "resume",
    "review",
    "run_scan",
    "scan_prefix",
    "scratch_scope",
    "validate_config",
]
