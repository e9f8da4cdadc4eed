from __future__ import annotations

import brute
import odd
import pytest
from pyspark.sql import functions as F

from orderlens.llm import mixing
from orderlens.llm.common import table
from orderlens.llm.queries import sized


def targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Targets by sharing and resharing until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()) * percent / 100, {s: 0.0 for s in sizes}, set(sizes)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            out[s] += share * weight[s]
        left = sum(max(0.0, out[s] - most * sizes[s]) for s in sizes)
        full = {s for s in open_ if out[s] >= most * sizes[s]}
        for s in full:
            out[s] = float(most * sizes[s])
        open_ -= full
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, "d": 100},
        {"a": 1, "b": 1000, "c": 5, None: 70, "": 3},
        {"a": 0, "b": 10},
        {"only": 7},
        {"z": 10**6, "é": 3, "\U0001f600": 5000, None: 0},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = targets(sizes)
    assert set(got) == set(want)
    for s, target in want.items():
        assert got[s] == pytest.approx(target, rel=1e-9, abs=1e-6)


def test_table_is_near_its_targets(spark, folder):
    docs = sized(table(spark, folder, "documents"))
    rows = mixing.mix(docs, carry=("doc_id", "source", "size")).collect()
    assert len(rows) == docs.count()
    taken, target, largest = {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)


def test_a_hot_source_is_spread_and_near_its_target(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("rest").alias("source"), (F.col("id") % 50).alias("size")
    )
    rows = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"))
    for r in rows.collect():
        assert abs(r.taken - r.target) <= 100


def test_odd_rows(spark):
    docs = sized(odd.documents(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd.DOC_ROWS)
    sizes = {}
    for r in odd.DOC_ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    whole = mixing.repeat_rows(mixing.mix(docs.withColumn("row", F.struct("*")), carry=("row",)))
    assert whole.count() == sum(r.copies for r in rows)


def test_no_rows(spark):
    assert mixing.mix(sized(odd.documents(spark, []))).collect() == []
