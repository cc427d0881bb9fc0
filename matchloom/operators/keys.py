"""Row order, cleaned keys, and the catalogue of distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.text import clean_key, ref

RID, KEY = "__rid", "__key"


def with_row_order(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Add the row position that every tie rule rests on.

    ``order_col`` must be a whole-number column without repeats or gaps (``check_row_order``). Without one the scan order is taken,
    which is only fixed once the result is stored: ``catalogue`` does that before any second use.
    """
    clash = [n for n in df.columns if n in (RID, KEY)]
    if clash:
        raise ValueError(f"reserved column name in the input: {', '.join(clash)}")
    if order_col is None:
        return df.withColumn(RID, F.monotonically_increasing_id())
    if not isinstance(df.schema[order_col].dataType, T.IntegralType):
        raise ValueError(f"row order needs a whole-number column, got {order_col}")
    return df.withColumn(RID, ref(order_col).cast("bigint"))


def check_row_order(df: DataFrame) -> None:
    """Raise unless every row has a position of its own: positions stand for keys from here on.

    One aggregation over one column; a position that many rows share is combined before the shuffle.
    """
    per = df.groupBy(RID).agg(F.count(F.lit(1)).alias("n"))
    missing = F.col(RID).isNull()
    seen = per.agg(F.count_if(missing).alias("missing"), F.count_if((F.col("n") > 1) & ~missing).alias("repeated")).first()
    if seen["missing"] or seen["repeated"]:
        what = "missing values" if seen["missing"] else f"{seen['repeated']} repeated values"
        raise ValueError(f"the order column needs one number of its own for each row; it has {what}")


def head_sample(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows by position, taken before any cleaning."""
    return df.orderBy(RID).limit(n)


def with_clean_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn(KEY, clean_key(df.schema, cols))


def drop_empty(df: DataFrame) -> DataFrame:
    """Only a wholly empty key goes; a key of spaces stays."""
    return df.filter(F.col(KEY) != "")


def source_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in (RID, KEY)]


def distinct_keys(df: DataFrame) -> DataFrame:
    """``key, pos``: the position is that of the first row. Partial aggregation absorbs hot keys."""
    return df.groupBy(F.col(KEY).alias("key")).agg(F.min(RID).alias("pos"))


def last_row_lookup(df: DataFrame) -> DataFrame:
    """``key, row``: the last row of a key is the one shown."""
    row = F.struct(*[ref(n) for n in source_columns(df)])
    return df.groupBy(F.col(KEY).alias("key")).agg(F.max_by(row, RID).alias("row"))


def catalogue(df: DataFrame) -> DataFrame:
    """``key, pos, row`` in one aggregation: first position and last row of each key.

    For rows whose position only holds within one scan; otherwise ``key_spans`` moves far less data.
    """
    row = F.struct(*[ref(n) for n in source_columns(df)])
    return df.groupBy(F.col(KEY).alias("key")).agg(
        F.min(RID).alias("pos"), F.max_by(row, RID).alias("row")
    )


def key_spans(df: DataFrame) -> DataFrame:
    """``key, pos, last``: first and last position of each key. A hash aggregation over two columns."""
    return df.groupBy(F.col(KEY).alias("key")).agg(F.min(RID).alias("pos"), F.max(RID).alias("last"))


def rows_for(df: DataFrame, spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pos, row`` for the wanted positions only: the shown rows are fetched once the matches are known."""
    row = F.struct(*[ref(n) for n in source_columns(df)])
    last = spans.join(wanted, "pos", "left_semi").select("pos", "last")
    return df.select(F.col(RID).alias("last"), row.alias("row")).join(last, "last").select("pos", "row")


def keyed(df: DataFrame, cols: Sequence[str], order_col: str | None = None, sample: int | None = None) -> DataFrame:
    """Order, sample, clean and drop empty keys."""
    df = with_row_order(df, order_col)
    if sample is not None:
        df = head_sample(df, sample)
    return drop_empty(with_clean_key(df, cols))
