from __future__ import annotations

import pytest
from samples import frame, random_rows, row, tuples

from orderlens import model as m
from orderlens.operators import base, frames

ORDER_KEY = [frames.Key(m.LAST_TREND, descending=True), frames.Key(m.ORDER)]


@pytest.fixture(scope="module")
def sample(spark):
    return frame(spark, random_rows(57, range(30), seed=3, gaps=0.2)).cache()


def orders(df):
    return sorted(r[m.ORDER] for r in df.collect())


def test_search_all_columns_ignoring_case(spark):
    df = frame(spark, [row(1, "Été chaud"), row(2, None, group="été"), row(3, "a(b"), row(777, "x", strength=12.0)])
    assert orders(frames.search(df, "ÉTÉ")) == [1, 2]
    assert orders(frames.search(df, "777")) == [777]
    assert orders(frames.search(df, r"^12\.0$")) == [777]
    assert orders(frames.search(df, "")) == [1, 2, 3, 777]
    assert orders(frames.search(df, ".")) == [1, 2, 3, 777]
    assert orders(frames.search(df, ".", literal=True)) == [1, 2, 3, 777]  # doubles have a dot
    assert orders(frames.search(df, "(", literal=True)) == [3]
    assert orders(frames.search(df, "none")) == [] and orders(frames.search(df, "null|nan")) == []
    with pytest.raises(frames.InvalidPattern):
        frames.search(df, "(")


def test_search_finds_large_numbers_as_written(spark):
    df = frame(spark, [row(1, strength=12345678.0)])
    assert frames.search(df, "12345678.0", literal=True).count() == 1


def test_pages_partition_the_frame(spark, sample):
    order = base.frame_order(sample.columns)
    pages = [tuples(frames.page(sample, i, order)) for i in range(7)]
    assert [len(p) for p in pages] == [10, 10, 10, 10, 10, 7, 0]
    assert [r for p in pages for r in p] == tuples(base.sorted_frame(sample))
    assert tuples(frames.page_count(sample)) == [(57, 6)]
    assert tuples(frames.page_count(sample.limit(0))) == [(0, 0)]


def test_keyset_pages_equal_offset_pages(spark, sample):
    unique = sample.dropDuplicates([m.ORDER]).cache()
    order = [key.sort for key in ORDER_KEY]
    seen = tuples(frames.page(unique, 0, order, 7))
    assert unique.filter(f"{m.LAST_TREND} IS NULL").count() > 1
    last = seen
    for number in range(1, 6):
        keys = [last[-1][unique.columns.index(key.name)] for key in ORDER_KEY]
        after = tuples(frames.page_after(unique, ORDER_KEY, keys, 7))
        assert after == tuples(frames.page(unique, number, order, 7))
        if not after:
            break
        last = after


def test_search_page(spark, sample):
    order = base.frame_order(sample.columns)
    found = frames.search_page(sample, "^x$", 0, order)
    matches = sample.filter(f"{m.COMMENT} = 'x'").count()
    assert [(r.row_count, r.page_count) for r in found.collect()] == [(matches, -(-matches // 10))] * min(10, matches)
    assert frames.search_page(sample, "^x$", 99, order).count() == 0


def test_last_rows_and_action_view(spark, sample):
    whole = tuples(base.sorted_frame(sample))
    assert tuples(frames.last_rows(sample)) == whole[-10:]
    view = frames.action_view(sample)
    assert view.columns[:4] == ["Order #", "Ingredient Group", "Order Str", "Cumul. Str"]
    assert view.columns[4:] == m.TREND_COLUMNS
    assert [r[0] for r in tuples(view)] == [r[1] for r in whole[-10:]]
    assert frames.action_view(sample.limit(0)).count() == 0


def test_trend_columns_by_name():
    assert m.trend_columns(["a", "TREND_X", "trend_y", "MY_TREND"]) == ["TREND_X", "MY_TREND"]


def test_lookup(spark, sample):
    whole = tuples(base.sorted_frame(sample))
    first = {}
    for r in whole:
        first.setdefault(r[1], r)
    assert sorted(tuples(frames.first_rows(sample)), key=repr) == sorted(first.values(), key=repr)
    some = whole[5][1]
    assert tuples(frames.order_lookup(sample, some)) == [first[some]]
    assert frames.order_lookup(sample, 10**9).isEmpty()
    wanted = spark.createDataFrame([(some,), (some,), (10**9,)], f"{m.ORDER} bigint")
    assert tuples(frames.first_rows(sample, wanted)) == [first[some]]


def test_profile_and_denied_columns(spark, sample):
    assert tuples(frames.profile(sample)) == [(57, 17)]
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "Sold_To_Id", "xSOLD_TOx", "a"])
    assert frames.deny_columns(df).columns == ["a", "a"]
    assert tuples(frames.deny_columns(df)) == [(1, 4)]
    assert frames.allowed_columns(["a", "Sold_To"]) == ["a"]


def test_search_has_one_condition_a_type(spark):
    """Not one for each of seventeen columns, which makes code too long to be compiled."""
    df = frame(spark, random_rows(5, range(3), seed=1))
    plan = frames.search(df, "c[12]")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iu)c[12]") + plan.count("RLIKE") <= 2 * len({kind for _, kind in df.dtypes})


def test_search_of_types_side_by_side(spark):
    df = spark.createDataFrame([(1, 2.5, 1e20, None, "a"), (2, None, 0.5, "2.5", None), (3, None, None, None, None)], "n int, x double, y double, s string, t string")
    found = lambda term: sorted(r.n for r in frames.search(df, term).collect())
    assert found(r"^2\.5$") == [1, 2] and found("1e") == [1] and found("^3$") == [3] and found("a") == [1] and found("^$") == []
