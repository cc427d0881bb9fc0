"""Small helpers that several operators share: input sizes, partition counts, checked broadcasts, sinks by doc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.plans.scratch import materialise_counted

#: Rows of at most some 40 bytes that a broadcast may hold; a larger side is shuffled.
BROADCAST_ROWS = 500_000


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def parts_for(df: DataFrame, total_bytes: float, per_part: int = 32 << 20) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more if they would be too large."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(wanted, int(total_bytes // per_part) + 1)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of a text column, by one scan of that column."""
    return docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast if a count shows that the (stored, narrow) table is small; else leave it to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def small_lists(df: DataFrame, column: str, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store a table of lists, and ask for a broadcast if rows and what their lists hold are few; else leave it to be shuffled."""
    stored, seen = materialise_counted(df, label, n=F.count(F.lit(1)), held=F.coalesce(F.sum(F.size(column)), F.lit(0)))
    return F.broadcast(stored) if 2 * seen["n"] + seen["held"] <= 4 * rows else stored


def hashed_out(id_col: str, parts: int, held: int) -> Column:
    """True for rows whose crc32 of the id, as text, leaves the held-out remainder; false for null ids."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % parts == held, F.lit(False))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The wanted names, lengthened where the input already has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
