"""Review decisions as table operators over an event log ``session, seq, ts, choice, note``.

Choices: A keep the item, B take the match, F flag, S skip, U undo the last decision. A session walks
through the matches in order, so a decision needs no match id: its place follows from the log.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.config import scan_prefix
from matchloom.functions.text import strip_text
from matchloom.operators.matches import project_ids
from matchloom.plans.scratch import materialise

# events of one part of the log, about: parts are cut by the number of events, not by their numbers
PART_EVENTS, LEAST_EVENTS = 65536, 4096
# parts whose carries one window may hold
FLAT_PARTS = 1024


def trim_note(note: Column) -> Column:
    return F.coalesce(strip_text(note), F.lit(""))


def one_session(events: DataFrame, session: str | None = None) -> DataFrame:
    """The log of one session. Raises if several are met without a choice, or if a number occurs twice."""
    if session is not None:
        events = events.filter(F.col("session") == session)
    elif len(events.select("session").distinct().limit(2).collect()) > 1:
        raise ValueError("the log holds several sessions; name one")
    if not events.groupBy("session", "seq").count().filter("seq is null or count > 1").isEmpty():
        raise ValueError("seq must be one number of its own for each event of a session")
    return events


def _before(ends: DataFrame, within: list[str], order: str) -> DataFrame:
    """Add ``b`` and ``f``: the sum of what comes before in ``within``, and its lowest running sum (NULL if nothing does)."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("b", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    return ends.withColumn("f", F.min(F.col("b") + F.col("low")).over(earlier))


def _carried(ends: DataFrame, parts: int) -> DataFrame:
    """``session, __part, __before, __floor`` from ``session, __part, t, low``, the sum and lowest running sum of parts.

    Many parts are carried in two levels: within runs of some sqrt(parts) parts, then over the runs, so that no window
    holds all parts of a session.
    """
    if parts <= FLAT_PARTS:
        return _before(ends, ["session"], "__part").select("session", "__part", F.col("b").alias("__before"), F.col("f").alias("__floor"))
    inside = _before(ends.withColumn("__run", F.expr(f"__part div {math.isqrt(parts)}")), ["session", "__run"], "__part")
    runs = inside.groupBy("session", "__run").agg(F.sum("t").alias("t"), F.min(F.col("b") + F.col("low")).alias("low"))
    runs = _before(runs, ["session"], "__run").select("session", "__run", F.col("b").alias("rb"), F.col("f").alias("rf"))
    # least() passes over NULL: the first run and the first part have nothing before them
    return inside.join(runs, ["session", "__run"]).select(
        "session", "__part", (F.col("rb") + F.col("b")).alias("__before"), F.least("rf", F.col("rb") + F.col("f")).alias("__floor")
    )


def replay_index(events: DataFrame) -> DataFrame:
    """Add ``idx``, the position after each event, and ``touched``, the 0-based match it concerns.

    +1 per decision, -1 per undo, never below 0: idx = S - min(0, lowest S so far), S the running sum.
    The log is cut into parts of about as many events, whatever their numbers. Running values are taken inside the
    parts and carried over between them, so one long session is spread over many tasks.
    """
    step = F.when(F.col("choice") == "U", -1).otherwise(1)
    n = events.count()
    cores = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # small logs still use the cores, but not for a handful of events each
    parts = max(1, math.ceil(n / PART_EVENTS), min(cores, n // LEAST_EVENTS))
    spread = events.withColumn("__step", step).repartitionByRange(parts, "session", "seq").withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("session", "__part").orderBy("seq")
    run = spread.withColumn("__sum", F.sum("__step").over(inside))
    # lowest running sum before each event, within its part
    run = run.withColumn("__low", F.min("__sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # read twice below, and the result usually more often
    run = materialise(run, "replay")
    ends = run.groupBy("session", "__part").agg(F.sum("__step").alias("t"), F.min("__sum").alias("low"))
    run = run.join(_carried(ends, parts), ["session", "__part"])
    total = F.col("__before") + F.col("__sum")
    # least() passes over NULL: the first event of a part or session has nothing before it
    before = F.least(F.lit(0), F.col("__before") + F.col("__low"), F.col("__floor"))
    undo = F.col("choice") == "U"
    out = run.withColumn("idx", total - F.least(before, total)).withColumn("noop", undo & (total < before))
    out = out.withColumn("touched", F.when(undo, F.col("idx")).otherwise(F.col("idx") - 1))
    return out.select(*events.columns, "idx", "touched", "noop")


def in_range(replayed: DataFrame, n_matches: int) -> DataFrame:
    """Cut each session at the event that finishes the last match; what follows is ignored."""
    ends = replayed.filter(F.col("idx") == n_matches).groupBy("session").agg(F.min("seq").alias("__end"))
    return (
        replayed.join(ends, "session", "left")
        .filter(F.col("__end").isNull() | (F.col("seq") <= F.col("__end")))
        .drop("__end")
        .filter(F.col("touched") < n_matches)
    )


def effective_decisions(replayed: DataFrame) -> DataFrame:
    """``session, match_id, choice, note, seq``: the last event of a match counts, unless it is an undo."""
    last = F.max_by(F.struct("choice", "note", "seq"), "seq").alias("last")
    return (
        replayed.filter(~F.col("noop"))
        .groupBy("session", (F.col("touched") + 1).alias("match_id"))
        .agg(last)
        .filter(F.col("last.choice") != "U")
        .select("session", "match_id", "last.choice", trim_note(F.col("last.note")).alias("note"), "last.seq")
    )


def attach_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    return matches.join(decisions, "match_id")


def pending_matches(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches still without a decision."""
    return matches.join(decisions, "match_id", "left_anti")


def final_selection(choice: Column) -> Column:
    return F.when(choice == "A", F.col("match_a")).when(choice == "B", F.col("match_b")).otherwise("")


def action(choice: Column, master_mode: bool) -> Column:
    # The actions.
    return (
        F.when(choice == "A", "Kept Original")
        .when(choice == "B", scan_prefix(master_mode)["override"])
        .when(choice == "F", "Flagged for Review")
    )


def decision_records(
    matches: DataFrame, decisions: DataFrame, master_mode: bool, primary_id: str = "", master_id: str = ""
) -> DataFrame:
    """The output record of every approved or flagged match, in match order. Skips leave none."""
    choice = F.col("choice")
    kept = attach_decisions(matches, decisions.filter(choice.isin("A", "B", "F")))
    return kept.orderBy("match_id").select(
        *project_ids(matches, master_mode, primary_id, master_id),
        F.col("match_a").alias("Primary Item"),
        F.col("match_b").alias("Matched Item"),
        F.col("score").alias("Score"),
        F.col("note").alias("Note"),
        final_selection(choice).alias("Final Selection"),
        action(choice, master_mode).alias("Action"),
    )


def flagged(records: DataFrame) -> DataFrame:
    return records.filter(F.col("Action") == "Flagged for Review")


def approved(records: DataFrame) -> DataFrame:
    return records.filter(F.col("Action") != "Flagged for Review")


def audit_trail(matches: DataFrame, replayed: DataFrame) -> DataFrame:
    """``session, seq, line``: one line per decision and effective undo."""
    on_match = Window.partitionBy("session", "touched").orderBy("seq")
    # on one match decisions and undos take turns, so an undo reverts the event before it
    events = replayed.filter(~F.col("noop")).withColumn("reverted", F.lag("choice").over(on_match))
    shown = matches.select((F.col("match_id") - 1).alias("touched"), "match_id", "score", "match_a", "match_b")
    number, a, b = F.col("match_id").cast("string"), F.col("match_a"), F.col("match_b")
    # The line formats.
    label = F.when(F.col("choice") == "A", "Keep A").when(F.col("choice") == "B", "Override B").otherwise("Flag")
    full = F.concat(
        F.lit("DECISION ["), label, F.lit("] #"), number, F.lit(" | Score="), F.col("score").cast("string"),
        F.lit(" | A='"), a, F.lit("' | B='"), b, F.lit("' | Note='"), trim_note(F.col("note")), F.lit("'"),
    )
    skip = F.concat(F.lit("DECISION [Skip] #"), number, F.lit(" | A='"), a, F.lit("' | B='"), b, F.lit("'"))
    undo = F.concat(
        F.lit("UNDO: reverted decision ["), F.col("reverted"), F.lit("] at index "), F.col("touched").cast("string")
    )
    line = F.when(F.col("choice") == "U", undo).when(F.col("choice") == "S", skip).otherwise(full)
    return events.join(shown, "touched").select("session", "seq", line.alias("line"))
