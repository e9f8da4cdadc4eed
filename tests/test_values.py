from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import tuples

from orderlens.functions.values import first_filled, has_number, text_form, to_number

TEXTS = ["12", " 12 ", "1e5", "1,000", "abc", "", "1d", "1f", None, "-3.5", "+4", ".5", "5.", "1e400", "NaN", "0x1A", "1_0", "\t7\n", "--1", "1 2"]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    kind = T.StringType()
    found = df.orderBy("i").select(to_number(F.col("t"), kind), has_number(F.col("t"), kind))
    expected = pd.to_numeric(pd.Series(TEXTS, dtype=object), errors="coerce")
    expected = [None if pd.isna(x) or abs(x) == float("inf") else float(x) for x in expected]
    assert [r[0] for r in found.collect()] == expected
    assert [r[1] for r in found.collect()] == [x is not None for x in expected]


def test_numbers_in_numbers(spark):
    df = spark.createDataFrame([(1.5, 2), (float("nan"), None), (None, 3)], "d double, i int")
    found = df.select(to_number(F.col("d"), T.DoubleType()), to_number(F.col("i"), T.IntegerType()))
    assert tuples(found) == [(1.5, 2.0), (None, None), (None, 3.0)]


def test_text_of_doubles_is_like_python(spark):
    values = [0.0, 1.0, -2.5, 12345678.0, 1e7, 123456789.125, 1e15, 9007199254740992.0, 1e16, 1.5e16, 1e20, 1e-3, 5e-4, 1e-5, 2.5e-7, 0.1, -1e22, 1e100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r[0] for r in df.orderBy("i").select(text_form(F.col("v"), T.DoubleType())).collect()]
    assert found == [repr(v) for v in values]


def test_first_filled(spark):
    df = spark.createDataFrame([("", "b"), (None, None), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(first_filled(F.col("x"), F.col("y"))).collect()] == ["b", None, "a"]
