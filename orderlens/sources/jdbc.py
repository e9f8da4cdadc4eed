"""Order and catalog tables of a SQL Server database, read over JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NumericType

from orderlens import model as m
from orderlens.sources.catalog import CatalogRoles
from orderlens.sources.roles import OrderRoles


def connection_options(
    server: str, database: str, username: str | None = None, password: str | None = None
) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``; without a user name, the session's own identity is used."""
    url = f"jdbc:sqlserver://{server};databaseName={database}"
    if username is None:
        return {"url": f"{url};integratedSecurity=true"}
    return {"url": url, "user": username, "password": password or ""}


# Rows that the driver class fetches at a time.
FETCH_ROWS = 10_000


def split_options(key: str, bounds: tuple[int, int] | None, parts: int) -> dict[str, str]:
    """Options that let ``parts`` tasks read a range of ``key`` each; none for an empty table or a single task."""
    if bounds is None or parts < 2 or bounds[0] == bounds[1]:
        return {}
    low, high = bounds
    # The upper bound only sets the stride; beyond it, the last task reads on.
    return {
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(min(parts, high - low + 1)),
    }


def key_bounds(spark: SparkSession, options: dict[str, str], name: str, key: str) -> tuple[int, int] | None:
    """The least and the largest key of a table, asked from the database; None if there is none."""
    found = read_query(spark, options, f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}").first()
    return None if found is None or found[0] is None else (int(found[0]), int(found[1]))


def literal(value: Any) -> str:
    """A key's value as the database writes it; whatever is no number is quoted."""
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def share_edges(spark: SparkSession, options: dict[str, str], name: str, key: str, parts: int) -> list[Any]:
    """The least key of each of ``parts`` equal shares of a table's rows, in the database's own order.

    Shares of a key that repeats much may start alike; such edges are given once.
    """
    shares = f"SELECT {key} AS edge, NTILE({parts}) OVER (ORDER BY {key}) AS part FROM {name} WHERE {key} IS NOT NULL"
    found = read_query(spark, options, f"SELECT part, MIN(edge) AS edge FROM ({shares}) AS shares GROUP BY part").collect()
    return list(dict.fromkeys(row["edge"] for row in sorted(found, key=lambda row: row["part"])))


def share_predicates(key: str, edges: Sequence[Any]) -> list[str]:
    """Conditions that cut a table at ``edges``: every row, null keys too, meets exactly one; none if there is nothing to cut."""
    if len(edges) < 2:
        return []
    inner = [literal(edge) for edge in edges[1:]]
    first = f"{key} < {inner[0]} OR {key} IS NULL"
    between = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(inner, inner[1:])]
    return [first, *between, f"{key} >= {inner[-1]}"]


def read_table(
    spark: SparkSession,
    options: dict[str, str],
    name: str,
    split_by: str | None = None,
    parts: int | None = None,
    shares: bool = False,
) -> DataFrame:
    """One table; with ``split_by``, ``parts`` tasks (by default one per core) read a range of that key each.

    Ranges of a number are of equal width between the table's own least and
    largest key. Those of any other key, and with ``shares`` those of an uneven
    number, hold equal shares of the rows; the database sorts the key for that.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name).option("fetchsize", FETCH_ROWS)
    whole = reader.load()
    count = parts or spark.sparkContext.defaultParallelism
    if not split_by or count < 2:
        return whole
    kind = next((f.dataType for f in whole.schema.fields if f.name.lower() == split_by.lower()), None)
    if kind is None or isinstance(kind, NumericType) and not shares:
        found = split_options(split_by, key_bounds(spark, options, name, split_by), count)
        return reader.options(**found).load() if found else whole
    predicates = share_predicates(split_by, share_edges(spark, options, name, split_by, count))
    if not predicates:
        return whole
    properties = {k: v for k, v in options.items() if k != "url"} | {"fetchsize": str(FETCH_ROWS)}
    return spark.read.jdbc(options["url"], name, predicates=predicates, properties=properties)


def read_query(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    """The result of a query that the database runs."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def base_query(top: int | None = m.LOAD_ROWS) -> str:
    """The six-table join with its filters as one query for the database: the first ``top`` rows by comment, or all.

    Rows that tie in the comment are ordered by the other columns, missing
    values last, so that the cut is the same every time.
    """
    source = {m.COMMENT: "j", m.GROUP: "g"}
    columns = [f"{source.get(c, 'h')}.{c}" for c in m.BASE_COLUMNS]
    texts, statuses = (", ".join(map(literal, values)) for values in (m.JOURNAL_TYPES, m.ORDER_STATUSES))
    rest = [c for c in columns if c != f"j.{m.COMMENT}"]
    order = [f"j.{m.COMMENT} DESC", *(part for c in rest for part in (f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END", c))]
    joins = [
        f"FROM {m.HIST_TABLE} h",
        f"JOIN {m.HEADER_TABLE} o ON o.ORDER_CD = h.{m.ORDER}",
        f"JOIN {m.DETAIL_TABLE} d ON d.{m.HEADER_ID} = o.{m.HEADER_ID} AND d.{m.GROUP_ID} = h.{m.GROUP_ID}",
        f"JOIN {m.JOURNAL_TABLE} j ON j.{m.HEADER_ID} = d.{m.HEADER_ID} AND j.{m.GROUP_ID} = d.{m.GROUP_ID}",
        f"JOIN {m.JOURNAL_TYPE_TABLE} t ON t.ORDER_JRNL_TYP_ID = j.ORDER_JRNL_TYP_ID",
        f"JOIN {m.GROUP_TABLE} g ON g.{m.GROUP_ID} = h.{m.GROUP_ID}",
        f"WHERE t.ORDER_JRNL_TYP_TXT IN ({texts}) AND d.ORDER_STATUS_CD IN ({statuses}) AND d.ORDER_SCORE_FCT <> {m.EXCLUDED_SCORE}",
    ]
    head = "SELECT" if top is None else f"SELECT TOP {top}"
    tail = [] if top is None else ["ORDER BY " + ", ".join(order)]
    return "\n".join([f"{head} {', '.join(columns)}", *joins, *tail])


def base_orders(spark: SparkSession, options: dict[str, str], top: int | None = m.LOAD_ROWS) -> DataFrame:
    """The joined and filtered orders, joined by the database: only the rows that are asked for come over.

    One task reads them. For all rows of a large history use ``order_tables``,
    which reads the tables in parallel, and join here.
    """
    return read_query(spark, options, base_query(top))


def order_tables(spark: SparkSession, options: dict[str, str], parts: int | None = None) -> OrderRoles:
    """The six order tables; the four large ones are read in parallel, each by ranges of its own key."""

    def split(name: str, key: str) -> DataFrame:
        return read_table(spark, options, name, key, parts)

    return OrderRoles(
        hist=split(m.HIST_TABLE, m.ORDER),
        hdr=split(m.HEADER_TABLE, m.HEADER_ID),
        detl=split(m.DETAIL_TABLE, m.HEADER_ID),
        jrnl=split(m.JOURNAL_TABLE, m.HEADER_ID),
        typ=read_table(spark, options, m.JOURNAL_TYPE_TABLE),
        grp=read_table(spark, options, m.GROUP_TABLE),
    )


def catalog_tables(spark: SparkSession, options: dict[str, str]) -> CatalogRoles:
    """The six catalog tables."""
    return CatalogRoles(
        *[
            read_table(spark, options, f"sys.{name}")
            for name in ("tables", "columns", "types", "schemas", "foreign_keys", "foreign_key_columns")
        ]
    )
