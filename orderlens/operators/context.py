"""The bounded context of other orders, as records and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens import model as m


def trend_map(trends: list[str]) -> Column:
    """The trends of a row as a map from column name to value."""
    return F.create_map(*[part for name in trends for part in (F.lit(name), F.col(name).cast("double"))])


def with_context(queries: DataFrame, records: DataFrame, size: int = m.CONTEXT_ROWS) -> DataFrame:
    """Add ``context``: the first ``size`` records of other orders, in frame order.

    ``records`` comes from ``first_records``, so it has at most ``2 * size``
    rows. It is evaluated once, as a scalar subquery; no join is needed.
    Every query row gets its own copy of up to ``size`` records.
    """
    trends = m.trend_columns(records.columns)
    rows = F.struct("position", m.ORDER, m.COMMENT, F.array(*[F.col(c).cast("double") for c in trends]).alias("values"))
    names = F.array(*[F.lit(name) for name in trends])
    all_records = records.agg(F.array_sort(F.collect_list(rows)).alias("rows")).select(
        F.transform(
            "rows",
            lambda x: F.struct(
                x[m.ORDER].alias("order_number"),
                x[m.COMMENT].alias("comment"),
                F.map_from_arrays(names, x["values"]).alias("trends"),
            ),
        )
    )
    number = F.col(m.ORDER)
    others = F.filter(F.col("_records"), lambda x: x["order_number"] != number)
    return queries.withColumn("_records", all_records.scalar()).select(
        *queries.columns, F.slice(others, 1, size).alias("context")
    )


def context_records(queries: DataFrame, records: DataFrame, size: int = m.CONTEXT_ROWS) -> DataFrame:
    """One row per query order and context record, with its place from 1."""
    found = with_context(queries.select(m.ORDER), records, size)
    return found.select(F.col(m.ORDER).alias("query_order"), F.posexplode("context").alias("at", "record")).select(
        "query_order", (F.col("at") + 1).alias("place"), "record.order_number", "record.comment", "record.trends"
    )


def context_json(queries: DataFrame, records: DataFrame, size: int = m.CONTEXT_ROWS) -> DataFrame:
    """Per query row, its context and its own trends as JSON text; missing values are ``null``."""
    trends = m.trend_columns(queries.columns)
    keep_nulls = {"ignoreNullFields": "false"}
    return with_context(queries, records, size).select(
        F.col(m.ORDER).alias("order_number"),
        F.to_json("context", keep_nulls).alias("base_orders"),
        F.to_json(trend_map(trends), keep_nulls).alias("trends"),
    )
