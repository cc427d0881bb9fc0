"""Column expressions for keys, display text and scores. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space at the ends of a text and between words, deleted punctuation, n-gram sizes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPLIT_PATTERN = r"(?U)[\s\x1c-\x1f]+"
DELETED_PATTERN = "[.,-]"
NGRAM_SIZES = (2, 3, 4)
MISSING_TEXT = "nan"
ABSENT_TEXT = "—"
DISPLAY_SEPARATOR = " | "
CONTEXT_SEPARATOR = "  |  "


def ref(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _double_text(c: Column) -> Column:
    """Shortest decimal text of a double; an exponent only from 1e16 up or below 1e-4."""
    plain = c.cast("string")
    size = F.abs(c)
    # 16 whole digits and 22 decimals hold every 17-digit double between those two bounds
    expanded = F.regexp_replace(plain.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), expanded)
        .when(exponent.between(-99, 99), scientific)
        .otherwise(F.concat(mantissa, sign, F.abs(exponent).cast("string")))
    )


def text_value(c: Column, dtype: T.DataType) -> Column:
    """A cell as text; NULL when the cell is missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        infinite = F.when(d > 0, "inf").otherwise("-inf")
        return (
            F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string"))
            .when(F.abs(d) == float("inf"), infinite)
            .otherwise(_double_text(d))
        )
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def blank_missing(c: Column, dtype: T.DataType) -> Column:
    """Text of a cell, empty when it is missing or reads exactly ``nan``."""
    text = text_value(c, dtype)
    return F.when(text != MISSING_TEXT, text).otherwise("")


def combine(schema: T.StructType, cols: Sequence[str]) -> Column:
    """All cells with one space after each."""
    return F.concat(*[p for n in cols for p in (blank_missing(ref(n), schema[n].dataType), F.lit(" "))])


def strip_text(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def clean_key(schema: T.StructType, cols: Sequence[str]) -> Column:
    """Strip, lower, then delete punctuation; the order matters, as a deletion can expose spaces."""
    return F.regexp_replace(F.lower(strip_text(combine(schema, cols))), DELETED_PATTERN, "")


def _shown(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(text_value(c, dtype), F.lit(MISSING_TEXT))


def display_value(row: str, fields: T.StructType, cols: Sequence[str]) -> Column:
    """The search cells of one stored row, joined for reading."""
    return F.concat_ws(DISPLAY_SEPARATOR, *[_shown(F.col(row)[n], fields[n].dataType) for n in cols])


def row_context(row: str, fields: T.StructType) -> Column:
    """Every cell of one stored row as ``name: value``."""
    parts = [F.concat(F.lit(f"{f.name}: "), _shown(F.col(row)[f.name], f.dataType)) for f in fields]
    return F.concat_ws(CONTEXT_SEPARATOR, *parts)


def field_text(row: str, fields: T.StructType, name: str) -> Column:
    """One raw cell for a field comparison; a dash when the table has no such column."""
    if name not in fields.names:
        return F.lit(ABSENT_TEXT)
    return _shown(F.col(row)[name], fields[name].dataType)


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPLIT_PATTERN), lambda w: w != "")


def token_sort_form(c: Column) -> Column:
    """The words of a text in code-point order, one space between."""
    return F.array_join(F.array_sort(words(c)), " ")


def char_wb_ngrams(c: Column) -> Column:
    """Character n-grams inside words padded by one space on each side."""

    def of_size(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        grams = F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>"))

    def grams_of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[of_size(padded, n) for n in NGRAM_SIZES])

    return F.flatten(F.transform(words(c), grams_of))


def round_score(c: Column) -> Column:
    """A score of 1..100 to one decimal, decided on the exact binary value, ties to even.

    Scaling by 2^52 is exact, so tenths and the rest are whole numbers: no decimal text is involved.
    """
    scale = 1 << 52
    tenths = (c * F.lit(float(scale))).cast("bigint") * 10
    whole = F.shiftright(tenths, 52)
    rest = tenths.bitwiseAND(F.lit(scale - 1))
    up = (rest > scale >> 1) | ((rest == scale >> 1) & (whole.bitwiseAND(F.lit(1)) == 1))
    return (whole + up.cast("bigint")) / F.lit(10.0)


def score_band(c: Column) -> Column:
    return F.when(c >= 95, "high").when(c >= 85, "medium").otherwise("low")
