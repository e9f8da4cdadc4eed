"""Lagged values and running totals over ordered series.

Rows are cut into contiguous ranges of series and order, and every range is
windowed by itself, led by the rows its lags reach back to and the sum so far.
A series that holds a third of the data is thus spread over many ranges.

Running totals are exact sums of the values rounded to ``SCALE`` decimals, so
neither the cuts nor the order of partial sums can show in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.model import LAGS, lag_name
from orderlens.session import store

# Decimals of the values that running totals add up; a value or total beyond 10**30 is missing.
SCALE = 8
EXACT = f"decimal(38,{SCALE})"


def _exact(value: Column) -> Column:
    return value.try_cast(EXACT)


def with_history(
    df: DataFrame,
    series: list[str],
    order: list[str],
    value: str,
    lags: int = LAGS,
    running: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``lags`` lag columns of ``value`` (oldest first) and a running total.

    ``order`` must be unique within a series. ``ranges`` is the number of
    ranges, by default that of shuffle partitions; it does not show in the
    result.
    """
    count = [] if ranges is None else [ranges]
    # Stored, so that the range of a row stays the same in every later job.
    ranged = store(
        df.repartitionByRange(*count, *series, *order).withColumn("_range", F.spark_partition_id()),
        "series-ranges",
    )
    piece = [*series, "_range"]

    # One short record per piece: its total and its last rows, oldest first.
    newest_first = Window.partitionBy(*piece).orderBy(*[F.desc(c) for c in order])
    tails = (
        ranged.withColumn("_back", F.row_number().over(newest_first))
        .filter(F.col("_back") <= lags)
        .groupBy(*piece)
        .agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value")))).alias("_tail"))
    )
    totals = ranged.groupBy(*piece).agg(F.sum(_exact(F.col(value))).alias("_total"))
    pieces = (
        tails.unionByName(totals, allowMissingColumns=True)
        .groupBy(*piece)
        .agg(F.first("_tail", ignorenulls=True).alias("_tail"), F.first("_total", ignorenulls=True).alias("_total"))
    )

    # What comes before a piece: the sum so far, and the rows its lags reach
    # back to. Every piece has a row, so `lags` earlier pieces always suffice.
    by_range = Window.partitionBy(*series).orderBy("_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    near = F.flatten(F.collect_list("_tail").over(by_range.rowsBetween(-lags, -1)))
    carried = pieces.select(*piece, F.sum("_total").over(before).alias("_sum"), near.alias("_near")).select(
        *piece,
        "_sum",
        F.posexplode(F.when(F.size("_near") > lags, F.slice("_near", -lags, lags)).otherwise(F.col("_near"))).alias(
            "_at", "_row"
        ),
    )

    # The carried rows join their piece as leading rows; the first brings the sum.
    leading = carried.select(
        *piece, "_row.*", F.lit(True).alias("_carried"), F.when(F.col("_at") == 0, F.col("_sum")).alias("_add")
    )
    own = ranged.select(
        "*", F.col(value).alias("_value"), F.lit(False).alias("_carried"), _exact(F.col(value)).alias("_add")
    )
    inside = Window.partitionBy(*piece).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = [F.sum("_add").over(upto).cast("double").alias(running)] if running else []
    added += [F.lag("_value", k).over(inside).alias(lag_name(k)) for k in range(lags, 0, -1)]
    rows = own.unionByName(leading, allowMissingColumns=True).select("*", *added)
    return rows.filter(~F.col("_carried")).drop("_range", "_value", "_carried", "_add")
