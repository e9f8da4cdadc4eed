"""Fields of connection strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names and the keys they are read from.
CONNECTION_KEYS = {
    "server": "data source",
    "database": "initial catalog",
    "username": "User ID",
    "password": "Password",
}


def connection_field(text: Column, key: str) -> Column:
    """The text after ``key=`` up to the next semicolon, key in any case; NULL if missing."""
    return F.nullif(F.regexp_extract(text, f"(?i){key}=([^;]+)", 1), F.lit(""))


def connection_fields(text: Column) -> list[Column]:
    return [connection_field(text, key).alias(name) for name, key in CONNECTION_KEYS.items()]
