"""Comparing a Spark result with the result of its SQL counterpart."""

from __future__ import annotations

import math
from typing import Any

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(row[i]) for i in order) for row in rows], key=repr)


# DuckDB type by Spark type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(df: Any, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL text: columns, types, row count, values."""
    result = con.execute(sql)
    theirs = {column[0]: str(column[1]) for column in result.description}
    expected = _rows(list(theirs), result.fetchall())
    ours = dict(df.dtypes)
    found = []
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    for name, kind in ours.items():
        if TYPES.get(kind) != theirs[name]:
            found.append(f"type of {name}: {kind} != {theirs[name]}")
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows != {len(expected)}")
    different = [(x, y) for x, y in zip(actual, expected) if x != y]
    if different:
        found.append(f"{len(different)} rows differ, first: {different[0]}"[:1500])
    return found
