"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest
from compare import connection, differences
from samples import final_plan

import __spark_entry__ as spark_entry
from orderlens.plans.oracle import ORACLE
from orderlens.plans.registry import QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, folder, con, name):
    df = spark_entry.queries()[name](spark, folder)
    assert differences(df, con, spark_entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_or_row_function(spark, folder, name):
    plan = final_plan(spark_entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLE) <= set(spark_entry.oracle_sql())
