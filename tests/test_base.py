from __future__ import annotations

import os
import re

from pyspark.sql import functions as F
from samples import FRAME_SCHEMA, final_plan, frame, roles, row, tuples

from orderlens import model as m
from orderlens import session
from orderlens.operators import base
from orderlens.plans import registry
from orderlens.sources import roles as sources

TYP = [(1, "Release"), (2, "Comment"), (5, "Hold"), (6, "release")]
GRP = [(1, "g1"), (2, "g2")]


def hist(order, group, lags=None):
    return (order, group, 5.0, 9.0, *(lags or [1.0] * 12))


def sample(spark, **changes):
    tables = {
        "hist": [hist(10, 1), hist(10, 2), hist(20, 1), hist(30, 1)],
        "hdr": [(1, 10), (2, 20), (3, 30)],
        "detl": [(1, 1, "P", 1), (1, 2, "C", 0), (2, 1, "I", -2), (3, 1, "X", 1)],
        "jrnl": [(1, 1, 1, "b"), (1, 1, 2, "a"), (1, 1, 5, "held"), (1, 2, 1, None), (2, 1, 1, "scored"), (3, 1, 1, "x")],
        "typ": TYP,
        "grp": GRP,
        **changes,
    }
    return roles(spark, **tables)


def test_join_filters_and_fan_out(spark):
    found = tuples(base.base_orders(sample(spark)).select(m.ORDER, m.GROUP, m.COMMENT))
    assert sorted(found, key=repr) == [(10, "g1", "a"), (10, "g1", "b"), (10, "g2", None)]


def test_null_status_score_and_type_are_dropped(spark):
    found = base.base_orders(
        sample(
            spark,
            detl=[(1, 1, None, 1), (1, 2, "P", None), (2, 1, "P", 1)],
            jrnl=[(1, 1, 1, "a"), (1, 2, 1, "b"), (2, 1, None, "c"), (2, 1, 2, "kept")],
        )
    )
    assert [r[m.COMMENT] for r in found.collect()] == ["kept"]


def test_case_is_exact_unless_asked(spark):
    tables = sample(spark, jrnl=[(1, 1, 6, "lower"), (1, 1, 1, "upper")], detl=[(1, 1, "p", 1)])
    assert base.base_orders(tables).count() == 0
    found = base.base_orders(tables, ignore_case=True)
    assert sorted(r[m.COMMENT] for r in found.collect()) == ["lower", "upper"]


def test_stored_copies(spark):
    from orderlens.sources.roles import stored

    assert sorted(tuples(base.base_orders(stored(sample(spark)))), key=repr) == sorted(
        tuples(base.base_orders(sample(spark))), key=repr
    )


def test_base_columns(spark):
    assert base.base_orders(sample(spark)).columns == m.BASE_COLUMNS


def test_top_comments_order_and_size(spark):
    df = frame(spark, [row(i, c) for i, c in enumerate(["a", None, "c", "b", None, "c"])])
    assert [(r[m.COMMENT], r[m.ORDER]) for r in base.top_comments(df, 4).collect()] == [
        ("c", 2),
        ("c", 5),
        ("b", 3),
        ("a", 0),
    ]
    assert base.top_comments(df, 5).collect()[-1][m.COMMENT] is None
    assert base.top_comments(df, None).count() == 6


def test_clean_trends_numbers_nan_and_missing(spark):
    none = [None] * 12
    rows = [
        row(1, lags=none),
        row(2, lags=[None] * 11 + [float("nan")]),
        row(3, lags=[float("nan")] + [None] * 10 + [4.0]),
        row(4, lags=[7.0] + [None] * 11),
    ]
    found = base.sorted_frame(base.clean_trends(frame(spark, rows)))
    assert [(r[m.ORDER], r["TREND_LAG12_STRNT"], r["TREND_LAG1_STRNT"]) for r in found.collect()] == [
        (3, None, 4.0),
        (4, 7.0, None),
    ]


def test_clean_trends_from_text(spark):
    schema = FRAME_SCHEMA.replace("TREND_LAG12_STRNT double", "TREND_LAG12_STRNT string").replace(
        "TREND_LAG1_STRNT double", "TREND_LAG1_STRNT string"
    )
    rows = [
        row(1, lags=["n/a"] + [None] * 10 + [" 3 "]),
        row(2, lags=["n/a"] + [None] * 10 + [""]),
        row(3, lags=["1e2"] + [None] * 10 + ["NaN"]),
    ]
    found = base.sorted_frame(base.clean_trends(spark.createDataFrame(rows, schema)))
    assert [(r[m.ORDER], r["TREND_LAG12_STRNT"], r["TREND_LAG1_STRNT"]) for r in found.collect()] == [
        (1, None, 3.0),
        (3, 100.0, None),
    ]


def test_empty_tables(spark):
    empty = sample(spark, jrnl=[])
    assert base.load_orders(empty).isEmpty()
    assert base.sorted_frame(base.load_orders(empty)).columns == m.BASE_COLUMNS


def test_top_rows_without_full_sort(spark):
    plan = final_plan(base.top_comments(base.base_orders(sample(spark)), 2))
    assert "TakeOrderedAndProject(limit=2" in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    from orderlens.sources.roles import order_roles

    plan = final_plan(base.accepted_detail(order_roles(spark, folder)))
    assert "In(ORDER_STATUS_CD, [C,I,P])" in plan and "Not(EqualTo(ORDER_SCORE_FCT,-2))" in plan
    assert "ORDERSTRENGTH" not in plan


def test_hot_journal_key_is_split(spark, settings, tmp_path):
    """One order with most of the comments: adaptive execution splits its partition."""
    n = 60_000
    tables = sample(spark)
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    many = spark.range(0, n, 1, 8)
    pad = F.sha2(F.col("id").cast("string"), 512)
    many.select(key.alias(m.HEADER_ID), F.lit(1).alias(m.GROUP_ID), F.lit(1).alias("ORDER_JRNL_TYP_ID"), pad.alias(m.COMMENT)).write.parquet(
        f"{tmp_path}/jrnl"
    )
    many.select(F.col("id").alias(m.HEADER_ID), (F.col("id") + 7).alias("ORDER_CD")).write.parquet(f"{tmp_path}/hdr")
    one = F.lit(1.0)
    many.select(
        (F.col("id") + 7).alias(m.ORDER), F.lit(1).alias(m.GROUP_ID), one.alias(m.STRENGTH), one.alias(m.CUMULATIVE),
        *[one.alias(c) for c in m.TREND_COLUMNS],
    ).write.parquet(f"{tmp_path}/hist")
    many.select(
        F.col("id").alias(m.HEADER_ID), F.lit(1).alias(m.GROUP_ID), F.lit("P").alias("ORDER_STATUS_CD"), F.lit(1).alias("ORDER_SCORE_FCT")
    ).write.parquet(f"{tmp_path}/detl")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("hist", "hdr", "detl", "jrnl")}
    from orderlens.sources.roles import OrderRoles

    hot = OrderRoles(**read, typ=tables.typ, grp=tables.grp)
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="200KB",
    )
    df = base.base_orders(hot)
    assert "SortMergeJoin(skew=true)" in final_plan(df)
    assert df.count() == n


def test_history_alone_builds_no_journal(spark, folder):
    """Queries of the history must not pay for the journal."""
    again = f"{folder}/."
    assert registry.page_keyset(spark, again).count() == registry.page_keyset(spark, folder).count()
    assert (spark.sparkContext.applicationId, again) not in sources._built
    assert sources.order_roles(spark, again).hist is sources.order_history(spark, again)[1]


def test_lines_are_shuffled_once_for_the_detail(spark, folder):
    plan = final_plan(sources.detail(spark, folder))
    assert "hashpartitioning(l_orderkey" in plan
    assert f"hashpartitioning(l_orderkey, {m.GROUP_ID}" not in re.sub(r"#\d+L?", "", plan)


def test_history_is_shuffled_once_for_the_journal(spark, settings):
    """Its wide rows move to meet the comments and, with broadcasts off, their group: never for the journal's own join."""
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    plan = base.base_orders(sample(spark))._jdf.queryExecution().executedPlan().toString()
    inside = plan[plan.index(f"SortMergeJoin [{m.HEADER_ID}") :]
    assert m.LAST_TREND not in inside


def test_pieces_of_the_series_are_removed(spark, folder):
    """What the history is made from is not kept beside it."""
    with session.scope(spark):
        sources.order_history(spark, f"{folder}/./.")
        kept = os.listdir(session.fresh_path(spark, "x").rpartition("/")[0])
    assert {name.rpartition("-")[0] for name in kept if not name.startswith("scope")} == {"detl", "hist"}
