from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from orderlens.session import fresh_path, scope, shared_folder, store


def pretend(master, folder=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=context)


def test_folder_is_read_from_the_session():
    assert shared_folder(pretend("spark://host:1", "hdfs://host/shared/")) == "hdfs://host/shared"


def test_cluster_needs_the_setting():
    with pytest.raises(ValueError):
        shared_folder(pretend("yarn"))


def test_local_session_gets_one_scratch_folder():
    spark = pretend("local[2]")
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_store_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.0])], "i int, s string, a array<double>")
    kept = store(df, "kept")
    assert kept.dtypes == df.dtypes
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_a_scope_removes_what_it_stored(spark):
    outside = store(spark.range(3), "outside")
    with scope(spark):
        inside = store(spark.range(5), "inside")
        files = inside.inputFiles()
        assert inside.count() == 5
        with scope(spark):
            assert store(spark.range(2), "deeper").count() == 2
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert outside.count() == 3
