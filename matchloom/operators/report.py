"""Counts and distributions over matches and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The score buckets, lowest first.
BUCKETS = ("50–60", "60–70", "70–80", "80–90", "90–100", "100")
BUCKET_STARTS = (50, 60, 70, 80, 90, 100)


def score_bucket(score: Column) -> Column:
    """Bucket of a rounded score; anything below 60 counts in the first."""
    out = F.lit(BUCKETS[0])
    for name, start in list(zip(BUCKETS, BUCKET_STARTS))[1:]:
        out = F.when(score >= start, name).otherwise(out)
    return out


def score_histogram(matches: DataFrame) -> DataFrame:
    """``bucket, n``, all six buckets always."""
    counted = matches.groupBy(score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))
    # six rows, so the global order costs nothing
    names = matches.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "place int, bucket string")
    return (
        names.join(counted, "bucket", "left")
        .orderBy("place")
        .select("bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def histogram_scale(histogram: DataFrame) -> DataFrame:
    """Each count against the largest one. The window sees six rows."""
    largest = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    return histogram.withColumn("share", F.col("n") / largest)


def scan_metrics(primary_keys: DataFrame, master_keys: DataFrame | None, matches: DataFrame) -> DataFrame:
    """Distinct keys per side and number of matches, in one row."""

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("what"))

    rows = tagged(primary_keys, "primary").unionAll(tagged(matches, "matches"))
    if master_keys is not None:
        rows = rows.unionAll(tagged(master_keys, "master"))
    return rows.agg(
        F.count_if(F.col("what") == "primary").alias("unique_primary"),
        F.count_if(F.col("what") == "master").alias("unique_master"),
        F.count_if(F.col("what") == "matches").alias("n_matches"),
    )


def review_summary(decisions: DataFrame, matches: DataFrame) -> DataFrame:
    """Approved, flagged, skipped and remaining. ``decisions`` holds the effective choice per match."""
    marks = decisions.select("choice").unionAll(matches.select(F.lit("match").alias("choice")))
    choice = F.col("choice")
    return marks.agg(
        F.count_if(choice.isin("A", "B")).alias("approved"),
        F.count_if(choice == "F").alias("flagged"),
        F.count_if(choice == "S").alias("skipped"),
        (F.count_if(choice == "match") - F.count_if(choice.isin("A", "B", "F", "S"))).alias("remaining"),
    )


def eta_text(seconds: Column) -> Column:
    """``Ns`` below a minute, else ``Nm Ns``."""
    whole = F.floor(seconds)
    minutes = F.format_string("%dm %ds", F.floor(seconds / 60), whole - 60 * F.floor(seconds / 60))
    return F.when(seconds < 60, F.format_string("%ds", whole)).otherwise(minutes)


def review_eta(replayed: DataFrame, n_matches: int) -> DataFrame:
    """Time left per session: elapsed / reviewed x remaining, from the events of ``replay_index``."""
    last = F.max_by("idx", "seq")
    elapsed = F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))
    got = replayed.groupBy("session").agg(last.alias("reviewed"), (elapsed / 1e6).alias("elapsed_sec"))
    left = F.lit(n_matches) - F.col("reviewed")
    seconds = F.when(F.col("reviewed") > 0, F.col("elapsed_sec") / F.col("reviewed") * left)
    return got.select(
        "session",
        "reviewed",
        left.alias("remaining"),
        F.when(F.col("reviewed") > 0, eta_text(seconds)).otherwise("–").alias("eta"),
    )
