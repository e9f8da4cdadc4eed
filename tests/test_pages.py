from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from samples import frame, random_rows, tuples

from orderlens import model as m
from orderlens.operators import base, frames
from orderlens.operators.pages import page_map


def whole(df):
    return tuples(base.sorted_frame(df))


@pytest.mark.parametrize("rows_per_part", [7, 64, 1000])
def test_pages_partition_the_frame(spark, rows_per_part):
    df = frame(spark, random_rows(230, range(40), seed=rows_per_part))
    pages = page_map(df, base.frame_order(df.columns), rows_per_part)
    expected = whole(df)
    assert (pages.row_count, pages.page_count(), pages.page_count(100)) == (230, 23, 3)
    found = [row for number in range(3) for row in tuples(pages.page(number, 100))]
    assert found == expected
    assert tuples(pages.page(11)) == expected[110:120]
    assert tuples(pages.slice(3, 50)) == expected[3:53]
    assert tuples(pages.page(23)) == [] == tuples(pages.page(10**12))
    assert pages.page(23).columns == df.columns


def test_a_late_page_equals_the_offset_and_opens_one_or_two_parts(spark):
    df = frame(spark, random_rows(3000, range(700), seed=5))
    order = base.frame_order(df.columns)
    pages = page_map(df, order, 100)
    assert pages.starts.count() > 15
    for number in (0, 123, 299):
        page = pages.page(number)
        assert tuples(page) == tuples(frames.page(df, number, order))
        assert len({f.rpartition("/part=")[2].partition("/")[0] for f in page.inputFiles()}) >= 1
        plan = page._jdf.queryExecution().executedPlan().toString()
        filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
        assert "part" in filters
        scans = [r for r in page.select(F.lit(1)).collect()]
        assert len(scans) == 10


def test_ties_and_repeated_rows(spark):
    df = frame(spark, random_rows(10, [1], seed=1) * 30)
    pages = page_map(df, base.frame_order(df.columns), 20)
    assert [r for n in range(pages.page_count()) for r in tuples(pages.page(n))] == whole(df)


def test_no_rows_and_odd_names(spark):
    df = spark.createDataFrame([], "part int, place int, `a b` string, at int")
    pages = page_map(df, [F.col("part")])
    assert (pages.row_count, pages.page_count(), pages.page(0).collect()) == (0, 0, [])
    df = spark.createDataFrame([(3, 1, "x", 1), (1, 2, None, 2), (None, 3, "y", 3)], "part int, place int, `a b` string, at int")
    pages = page_map(df, [F.col("part").asc_nulls_last()])
    assert [tuple(r) for r in pages.page(0).collect()] == [(1, 2, None, 2), (3, 1, "x", 1), (None, 3, "y", 3)]
    assert pages.page(0).columns == df.columns


def test_search_page_counts_while_it_cuts(spark):
    df = frame(spark, random_rows(300, range(60), seed=7))
    order = base.frame_order(df.columns)
    found = whole(frames.search(df, "c[12]"))
    for number in (0, 2, 10**6):
        page = frames.search_page(df, "c[12]", number, order)
        assert page.columns == [*df.columns, "row_count", "page_count"]
        assert [tuple(r) for r in page.collect()] == [(*r, len(found), -(-len(found) // 10)) for r in found[number * 10 : number * 10 + 10]]
    assert m.ORDER in df.columns
