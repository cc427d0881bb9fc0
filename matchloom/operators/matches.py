"""From scored pairs to the match table: rows attached, ordered, numbered and shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.config import scan_prefix
from matchloom.functions.text import (
    display_value,
    field_text,
    ref,
    round_score,
    row_context,
    text_value,
)
from matchloom.operators.fuzzy import token_sort_ratio
from matchloom.plans.scratch import materialise

_WITHIN_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def fields(df: DataFrame, row: str) -> T.StructType:
    return df.schema[row].dataType


def attach_rows(pairs: DataFrame, lookup_a: DataFrame, lookup_b: DataFrame) -> DataFrame:
    """Add the full row of both sides by position; a pair without both rows is dropped."""
    a = lookup_a.select(F.col("pos").alias("pos_a"), F.col("row").alias("row_a"))
    b = lookup_b.select(F.col("pos").alias("pos_b"), F.col("row").alias("row_b"))
    return pairs.join(a, "pos_a").join(b, "pos_b")


def build_matches(attached: DataFrame, cols_a: Sequence[str], cols_b: Sequence[str]) -> DataFrame:
    """Rounded score and display text beside the rows."""
    return attached.select(
        round_score(F.col("raw")).alias("score"),
        display_value("row_a", fields(attached, "row_a"), cols_a).alias("match_a"),
        display_value("row_b", fields(attached, "row_b"), cols_b).alias("match_b"),
        "row_a",
        "row_b",
        "pos_a",
        "pos_b",
        "rank",
    )


def rank_matches(matches: DataFrame) -> DataFrame:
    """Number all matches from 1 by falling score, then item, then rank, without one global task.

    A range sort fixes the order; each row keeps its place inside its partition, and the partition sizes
    (one small row each) give the offsets.
    """
    order = [F.desc("score"), F.asc("pos_a"), F.asc("rank")]
    place = F.monotonically_increasing_id()
    ordered = materialise(matches.orderBy(*order).withColumn("__place", place), "ordered-matches")
    part = F.shiftright("__place", _WITHIN_BITS)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # one row per sorted partition, so this window and the broadcast stay tiny
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.col("__place").bitwiseAND(F.lit((1 << _WITHIN_BITS) - 1))
    numbered = ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.select((F.col("offset") + within + 1).alias("match_id"), *matches.columns)


def prefix_rows(matches: DataFrame) -> list[Column]:
    """``A_<col>`` and ``B_<col>`` for every source column."""
    a = [F.col("row_a")[f.name].alias(f"A_{f.name}") for f in fields(matches, "row_a")]
    b = [F.col("row_b")[f.name].alias(f"B_{f.name}") for f in fields(matches, "row_b")]
    return a + b


def match_export(matches: DataFrame) -> DataFrame:
    """The raw match table as it is handed out, in match order."""
    return matches.orderBy("match_id").select(
        F.col("score").alias("Score (%)"),
        F.col("match_a").alias("Primary Item"),
        F.col("match_b").alias("Matched Item"),
        *prefix_rows(matches),
    )


def _id_of(matches: DataFrame, row: str, name: str) -> Column:
    schema = fields(matches, row)
    if not name or name not in schema.names:
        return F.lit("")
    return F.coalesce(text_value(F.col(row)[name], schema[name].dataType), F.lit(""))


def project_ids(matches: DataFrame, master_mode: bool, primary_id: str = "", master_id: str = "") -> list[Column]:
    """Ids of both rows, empty without an id column. In dedupe both come from the primary id column."""
    other = scan_prefix(master_mode)["other_id"]
    return [
        _id_of(matches, "row_a", primary_id).alias("Primary_ID"),
        _id_of(matches, "row_b", master_id if master_mode else primary_id).alias(other),
    ]


def field_scores(matches: DataFrame, mappings: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per match and column pair: both raw cells and their unrounded token-sort score."""
    a, b = fields(matches, "row_a"), fields(matches, "row_b")
    pairs = [
        F.struct(
            F.lit(n).alias("field"),
            F.lit(p).alias("p_col"),
            F.lit(m).alias("m_col"),
            field_text("row_a", a, p).alias("val_a"),
            field_text("row_b", b, m).alias("val_b"),
        )
        for n, (p, m) in enumerate(mappings, 1)
    ]
    long = matches.select("match_id", F.explode(F.array(*pairs)).alias("f")).select("match_id", "f.*")
    return long.withColumn("field_score", token_sort_ratio(F.col("val_a"), F.col("val_b")))


def with_context(matches: DataFrame) -> DataFrame:
    """Full text of both rows for reading."""
    return matches.withColumns(
        {
            "context_a": row_context("row_a", fields(matches, "row_a")),
            "context_b": row_context("row_b", fields(matches, "row_b")),
        }
    )


def join_back(source: DataFrame, decisions: DataFrame, id_col: str, decision_id: str = "Primary_ID") -> DataFrame:
    """Decisions onto the source rows they concern; rows without a decision stay."""
    text = text_value(ref(id_col), source.schema[id_col].dataType)
    return source.withColumn("__id", text).join(
        decisions.withColumnRenamed(decision_id, "__id"), "__id", "left"
    ).drop("__id")
