"""Running a read-only query and reporting its outcome."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType

from orderlens import model as m
from orderlens.functions.answers import extract_queries
from orderlens.plans import guard
from orderlens.session import store
from orderlens.sources.roles import OrderRoles

# Outcome texts.
NO_CONTEXT = "We couldn't connect to the database. Please try again later or contact support."
NO_QUERY = "We couldn't understand your question. Please try rephrasing it or being more specific."
QUERY_FAILED = "We couldn't find the information you requested. Please try a different question."
NOTHING_FOUND = "No records found matching your criteria. Please try a different search."
NOTHING_SUMMARY = "No data found that matches your criteria."
FOUND = "Found {rows} records matching your query."
FOUND_SUMMARY = "Found {rows} records with {columns} columns."
EXPLAINED = "\n\nThis shows: {explanation}"


@dataclass(frozen=True)
class QueryResult:
    """Outcome of a query; ``results`` are stored rows, so using them does not run the query again."""

    success: bool
    results: DataFrame | None
    message: str
    summary: str | None
    sql_query: str | None = None
    row_count: int | None = None
    column_count: int | None = None


# Names of published views, by application.
_published: dict[str, set[str]] = {}


def publish(df: DataFrame, name: str) -> None:
    """Make ``df`` known to queries, without its denied columns and fields: a query that names one fails."""
    guard.without_denied(df).createOrReplaceTempView(name)
    _published.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(name.lower())


def register(roles: OrderRoles) -> None:
    """Make the six tables known to SQL under their table names."""
    names = (m.HIST_TABLE, m.HEADER_TABLE, m.DETAIL_TABLE, m.JOURNAL_TABLE, m.JOURNAL_TYPE_TABLE, m.GROUP_TABLE)
    for name, df in zip(names, (roles.hist, roles.hdr, roles.detl, roles.jrnl, roles.typ, roles.grp)):
        publish(df, name)


def select(spark: SparkSession, sql: str, functions: Collection[str] = ()) -> DataFrame:
    """The result of one SELECT over published views, without denied columns; see ``guard.checked`` for what may run.

    ``functions`` names registered functions that are allowed besides Spark's own.
    """
    known = _published.get(spark.sparkContext.applicationId, set())
    return guard.without_denied(guard.checked(spark, sql.strip(), known, functions))


def _storable(kind: DataType) -> bool:
    """Whether Parquet has the type."""
    if isinstance(kind, StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (NullType, CalendarIntervalType))


def evaluate(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a stored table in its own order, and its row count, observed while it is written.

    Columns of a type that cannot be stored are evaluated but not kept: then
    ``df`` itself is given back. A plain count would skip columns, and with
    them their errors.
    """
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    if not names or not _storable(df.schema):
        whole_row = F.struct("*").cast("string")
        return df, numbered.agg(F.count(F.lit(1)).alias("rows"), F.max(F.length(whole_row))).first()["rows"]
    sorted_rows = guard.keeps_order(df)
    if sorted_rows:
        numbered = numbered.withColumn("place", F.monotonically_increasing_id())
    seen = Observation()
    found = store(numbered.observe(seen, F.count(F.lit(1)).alias("rows")), "result")
    if sorted_rows:
        found = found.orderBy("place").drop("place")
    return found.toDF(*names), seen.get["rows"]


def run_query(
    spark: SparkSession,
    sql: str | None,
    explanation: str = "",
    max_rows: int | None = None,
    context: str | None = "",
    functions: Collection[str] = (),
) -> QueryResult:
    """Run ``sql`` once and describe the outcome; errors and refused queries become a failed result.

    ``context`` is the schema outline the query was written from; None says
    that there was none. ``max_rows`` cuts the result, if given.
    """
    if context is None or "Error:" in context:
        return QueryResult(False, None, NO_CONTEXT, None)
    if not sql:
        return QueryResult(False, None, NO_QUERY, None)
    try:
        results = select(spark, sql, functions)
        if max_rows is not None:
            results = results.limit(max_rows)
        results, rows = evaluate(results)
    except (PySparkException, guard.RefusedQuery):
        return QueryResult(False, None, QUERY_FAILED, None, sql)
    columns = len(results.columns)
    if rows == 0:
        return QueryResult(True, results, NOTHING_FOUND, NOTHING_SUMMARY, sql, 0, columns)
    summary = FOUND_SUMMARY.format(rows=rows, columns=columns)
    if explanation:
        summary += EXPLAINED.format(explanation=explanation)
    return QueryResult(True, results, FOUND.format(rows=rows), summary, sql, rows, columns)


def run_answer(
    spark: SparkSession, answer: str, max_rows: int | None = None, context: str | None = ""
) -> QueryResult:
    """Run the query found in a text answer; see ``extract_queries``."""
    if context is None or "Error:" in context:
        return run_query(spark, None, context=None)
    given = spark.createDataFrame([(answer,)], "answer string")
    found = extract_queries(given, "answer").first()
    return run_query(spark, found["sql_query"], found["explanation"], max_rows, context)
