"""A frame in page order, with a map from row numbers to the parts that hold them.

Rows are range-partitioned by the order of the frame and written part by part.
Counting the parts and summing the counts gives every part's first row number,
so any page, however far, is found from the map and read from one part, or two
if it crosses an edge. The map has a row per part, and never the frame's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.session import fresh_path, store

ROWS_PER_PART = 100_000

# monotonically_increasing_id has the partition above these bits and the place in it below.
_PLACE_BITS = 33


@dataclass(frozen=True)
class PageMap:
    """A stored frame (``rows``, with part and place) and its parts (``starts``: part, first, n).

    Columns are numbered in the stored rows, so that their names may be anything.
    """

    rows: DataFrame
    starts: DataFrame
    names: tuple[str, ...]
    row_count: int

    def page_count(self, size: int = m.PAGE_ROWS) -> int:
        return -(-self.row_count // size)

    def page(self, number: int, size: int = m.PAGE_ROWS) -> DataFrame:
        """Page ``number`` (from 0), in order; a page past the end is empty."""
        return self.slice(number * size, size)

    def slice(self, first: int, n: int) -> DataFrame:
        """The ``n`` rows from row number ``first`` (from 0) on, in order.

        The filter is on the column the files are partitioned by, so other
        parts are not opened.
        """
        last = first + n
        # A row per part that is touched; the map says which.
        hit = self.starts.filter((F.col("first") < last) & (F.col("first") + F.col("n") > first)).orderBy("part").collect()
        place = F.col("place")
        wanted = F.lit(False)
        for part in hit:
            inside = place.between(max(0, first - part["first"]), last - part["first"] - 1)
            wanted = wanted | ((F.col("part") == part["part"]) & inside)
        some = self.rows.filter(F.col("part").isin([p["part"] for p in hit])).filter(wanted)
        return some.orderBy("part", "place").drop("part", "place").toDF(*self.names)


def page_map(df: DataFrame, order: Sequence[Column], rows_per_part: int = ROWS_PER_PART) -> PageMap:
    """``df`` stored in ``order``, in parts of about ``rows_per_part`` rows, with its map.

    ``order`` should tell all rows apart; rows that tie share a part. ``df`` is
    evaluated three times (counted, sampled, written): store it first if that
    is dear.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // rows_per_part))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = ordered.withColumn("__at", at)
    numbered = numbered.toDF(*[f"c{i}" for i in range(len(df.columns))], "at")
    bits = F.lit((1 << _PLACE_BITS) - 1)
    placed = numbered.withColumns({"part": F.shiftright("at", _PLACE_BITS), "place": F.col("at").bitwiseAND(bits)}).drop("at")
    path = fresh_path(spark, "pages")
    placed.write.partitionBy("part").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    # One row per part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "page-map")
    total = starts.agg(F.sum("n")).first()[0] or 0
    return PageMap(rows, starts, tuple(df.columns), total)
