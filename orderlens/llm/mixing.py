"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, the
source's target size over its size. These are prefix-summed over the source's
documents in order of size, one random offset per source is added, and a
document is emitted once for every whole number its step crosses. Ordering by
size keeps the words taken within about two documents of the target.

A document's place within its source comes from a range partitioning by
source, size and id: rows are counted per partition and source, and a row's
place is its place in the partition plus the counts of the partitions before.
So a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import WORD
from orderlens.session import store

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = 17

# An offset is one of 2**20 steps, so that sums with whole numbers are exact.
OFFSET_DIGITS, OFFSET_STEPS = 5, 1_048_576


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size).

    Weights repeat over the sources in code-point order, null last. A source's
    target is at most ``most`` times its size; what is cut off is shared by
    weight among the others until none is above. That is the level at which
    weight times level, cut at the limit, adds up to the total.

    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))[((F.row_number().over(order) - 1) % len(weights)).cast("int")]
    weighed = per.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    # Sources reach their limit in the order of limit over weight.
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    goal = F.sum("source_size").over(whole) * F.lit(share_percent / 100.0)
    full = F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    steps = weighed.select("*", F.row_number().over(filling).alias("turn"), ((goal - full) / open_weight).alias("level"))
    # The level is that of the first source it leaves below its limit.
    below = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("turn"))
    found = steps.withColumn("level", F.min_by("level", below).over(whole))
    limit = F.col("limit").cast("double")
    target = F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit)
    return found.select("source", "source_size", "n", target.alias("target"))


def offset(source: Column, seed: int = SEED) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    digits = F.substring(F.md5(name), 1, OFFSET_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(OFFSET_STEPS))


def mix(
    docs: DataFrame,
    carry: Sequence[str] = ("doc_id", "source", "size"),
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """The ``carry`` columns of every row of ``docs`` and source_size, target, copies.

    ``docs`` has doc_id, source and size (words, not null; null texts count 0).
    A null source is a source of its own, the last in order. Documents that
    tie in size are taken in order of doc_id, nulls first; repeated rows are
    documents of their own and interchangeable. A source without words gets no
    copies. An empty table gives an empty result. Columns that are not carried
    are ignored.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    rows = store(docs.select(*dict.fromkeys([*carry, "doc_id", "source", "size"])), "sizes")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # The id's upper part is the partition, the lower one the place in it.
    placed = store(dealt.withColumns({"__part": F.shiftright(at, 33), "__at": at}), "places")
    parts = placed.groupBy("source", "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("source").alias("s"),
        F.col("__part").alias("p"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    targets = source_targets(rows.select("source", "size"), weights, share_percent, most)
    totals = targets.select(F.col("source").alias("t"), "source_size", "target")
    known = starts.join(totals, F.col("s").eqNullSafe(F.col("t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("__at") + F.col("shift") + 1
    reached = F.floor(rate * place + offset(F.col("source"), seed))
    passed = F.floor(rate * (place - 1) + offset(F.col("source"), seed))
    # A key that is never null, so that the join can split a source's rows.
    joined = placed.join(known, (F.col("__part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    copies = F.least(reached - passed, F.lit(most)).cast("long")
    return joined.select(*carry, "source_size", "target", copies.alias("copies"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Every row as many times as it has copies."""
    return mixed.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
