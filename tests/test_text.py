import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import text

from brute import grams


def one(spark, schema, row, build):
    df = spark.createDataFrame([row], schema)
    return df.select(build(df).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "row, key",
    [
        (("Acme, Inc.",), "acme inc"),
        (("  Acme\t",), "acme"),
        (("- acme",), " acme"),  # strip comes before deletion
        (("a", None, "b"), "a  b"),  # a blank middle column keeps its space
        (("nan",), ""),  # the text nan counts as missing
        (("---",), ""),
        (("- -",), " "),  # not empty
        (("A_B/C",), "a_b/c"),
        (("nan nan", "x"), "nan nan x"),  # only a whole cell is blanked
        (("\x1c x \n",), "x"),
    ],
)
def test_clean_key(spark, row, key):
    names = [f"c{i}" for i in range(len(row))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    assert one(spark, schema, row, lambda df: text.clean_key(df.schema, names)) == key


def test_numbers_in_keys(spark):
    # a whole-number column with gaps stays whole; the point inside a decimal is deleted
    df = spark.createDataFrame([(5551, 12.5), (None, float("nan"))], "phone long, size double")
    got = [r["k"] for r in df.select(text.clean_key(df.schema, ["phone", "size"]).alias("k")).collect()]
    assert got == ["5551 125", ""]


def test_double_text_reads_like_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 12345678.0, 1e15, 1.5e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 1e-3, 1.25e-4, 1e-5, -2.5e-7, 1e100, -1e-100]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 17) for _ in range(300)]
    values = [float(repr(v)) for v in values if len(repr(v)) < 18]  # the JVM may print a last digit more than needed
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["t"] for r in df.select(text.text_value(F.col("v"), T.DoubleType()).alias("t")).collect()]
    assert got == [str(v) for v in values]


def test_truth_text(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r["t"] for r in df.select(text.text_value(F.col("v"), T.BooleanType()).alias("t")).collect()] == ["True", "False", None]


def test_round_score_is_python_round(spark):
    rng = random.Random(5)
    values = [k / 20 for k in range(20, 2001)] + [rng.uniform(1, 100) for _ in range(2000)]
    values += [(1 - d / s) * 100 for s in range(1, 120) for d in range(0, s // 2)]  # all above 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["x"] for r in df.select(text.round_score(F.col("v")).alias("x")).collect()]
    assert got == [round(v, 1) for v in values]


def test_ngrams(spark):
    cases = ["x", "bc", " ", "a bc def", "wörter über", "aaaa aaaa", "ab\tcd"]
    df = spark.createDataFrame([(c,) for c in cases], "k string")
    got = [r["g"] for r in df.select(text.char_wb_ngrams(F.col("k")).alias("g")).collect()]
    for case, found in zip(cases, got):
        assert sorted(found) == sorted(grams(case).elements())
    assert sorted(got[0]) == [" x", " x ", "x "]


def test_display_and_context(spark):
    df = spark.createDataFrame([(("Ann", None, 1.0),)], "row struct<name:string,city:string,size:double>")
    fields = df.schema["row"].dataType
    got = df.select(
        text.display_value("row", fields, ["size", "city", "name"]).alias("d"),
        text.row_context("row", fields).alias("c"),
        text.field_text("row", fields, "none").alias("f"),
    ).first()
    assert got["d"] == "1.0 | nan | Ann"
    assert got["c"] == "name: Ann  |  city: nan  |  size: 1.0"
    assert got["f"] == "—"


def test_score_band(spark):
    df = spark.createDataFrame([(95.0,), (94.9,), (85.0,), (84.9,)], "s double")
    assert [r["b"] for r in df.select(text.score_band(F.col("s")).alias("b")).collect()] == ["high", "medium", "medium", "low"]


def test_white_space_is_that_of_python(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    assert sorted(spaces) == sorted(text.SPACES)
    values = [f"{s}a{s}b{s}" for s in spaces] + ["".join(spaces), "​x​"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(text.strip_text(F.col("v")).alias("s"), text.words(F.col("v")).alias("w")).collect()
    assert [r["s"] for r in got] == [v.strip() for v in values]
    assert [r["w"] for r in got] == [v.split() for v in values]
