from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from samples import tuples

from orderlens.operators.series import with_history


def brute_force(rows, lags):
    expected = []
    for key in {r[0] for r in rows}:
        series = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        total = None
        for i, r in enumerate(series):
            if r[3] is not None:
                total = (total or 0.0) + r[3]
            before = [series[i - k][3] if i >= k else None for k in range(lags, 0, -1)]
            expected.append((*r, total, *before))
    return sorted(expected, key=repr)


@pytest.mark.parametrize("ranges", [None, 1, 3, 17, 120])
def test_series_equal_brute_force(spark, ranges):
    pick = random.Random(5)
    # Series 0 holds most rows; two have a single row; one has no key.
    keys = [0] * 260 + [1] * 100 + [2] * 30 + [3, 4] + [None] * 50
    rows = [
        (key, pick.randrange(40), i, None if pick.random() < 0.1 else float(pick.randrange(50)))
        for i, key in enumerate(keys)
    ]
    df = spark.createDataFrame(rows, "key int, day int, id int, strength double")
    found = with_history(df, ["key"], ["day", "id"], "strength", running="total", ranges=ranges)
    assert found.columns[:5] == ["key", "day", "id", "strength", "total"]
    assert found.columns[5] == "TREND_LAG12_STRNT" and found.columns[-1] == "TREND_LAG1_STRNT"
    assert sorted(tuples(found), key=repr) == brute_force(rows, 12)


def test_empty_series(spark):
    df = spark.createDataFrame([], "key int, day int, strength double")
    assert with_history(df, ["key"], ["day"], "strength").count() == 0


def test_ranges_do_not_show_in_random_doubles(spark):
    pick = random.Random(3)
    rows = [(0 if n % 3 else n % 7, n, pick.uniform(-1e6, 1e6) ** pick.choice([1, 3]), 0) for n in range(2000)]
    df = spark.createDataFrame(rows, "key int, day int, strength double, x int")
    results = []
    for ranges in (1, 2, 9, 64):
        found = with_history(df.repartition(ranges), ["key"], ["day"], "strength", running="total", ranges=ranges)
        results.append(sorted(tuples(found), key=repr))
    assert all(r == results[0] for r in results)
    for key in {r[0] for r in rows}:
        mine = [r for r in results[0] if r[0] == key]
        mine.sort(key=lambda r: r[1])
        exact = sum((Decimal(r[2]).quantize(Decimal("1e-8"), ROUND_HALF_UP) for r in mine), Decimal(0))
        assert mine[-1][4] == float(exact)


def test_a_hot_series_is_many_ranges(spark):
    df = spark.range(4000).selectExpr("cast(0 as int) as key", "id as day", "cast(id as double) as strength")
    found = with_history(df, ["key"], ["day"], "strength", running="total", ranges=16)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert found.count() == 4000 and max(sizes) < 2000
    kept = [f for f in found.inputFiles() if "series-ranges" in f]
    assert len(kept) > 8


def test_values_that_are_no_numbers(spark):
    rows = [(1, 1, 1.0), (1, 2, float("nan")), (1, 3, None), (1, 4, 2.5)]
    df = spark.createDataFrame(rows, "key int, day int, strength double")
    found = with_history(df, ["key"], ["day"], "strength", running="total")
    assert [r.total for r in found.orderBy("day").collect()] == [1.0, 1.0, 1.0, 3.5]
