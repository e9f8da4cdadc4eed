"""XML configuration records and CSV output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.connections import connection_field
from orderlens.functions.values import first_filled

# Record element and fields.
COMPANY_TAG = "Company"
COMPANY_SCHEMA = "Name string, n string, ServerName string, ConnectionString string"


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Server records of XML files, any number of them."""
    raw = spark.read.format("xml").option("rowTag", COMPANY_TAG).schema(COMPANY_SCHEMA).load(path)
    return companies(raw, [F.col(c) for c in ("Name", "n", "ServerName", "ConnectionString")])


def parse_companies(df: DataFrame, xml: str) -> DataFrame:
    """Server records of a column that holds one XML element per row."""
    found = df.select("*", F.from_xml(F.col(xml), COMPANY_SCHEMA).alias("_c"))
    return companies(found, [F.col(f"_c.{c}") for c in ("Name", "n", "ServerName", "ConnectionString")], df.columns)


def companies(df: DataFrame, fields: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Name and server, each from the first field that has it; rows without a server are dropped."""
    name, short, server, connection = fields
    return df.select(
        *(keep or []),
        F.coalesce(first_filled(name, short), F.lit("")).alias("name"),
        first_filled(server, connection_field(connection, "data source")).alias("server"),
    ).filter(F.col("server").isNotNull())


# CSV dialect: header, doubled quotes, empty text for NULL, as little quoting as possible.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, one per task."""
    df.write.options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: object) -> DataFrame:
    """Read what ``write_csv`` wrote; line breaks inside quotes are kept, and empty text comes back as NULL."""
    return spark.read.options(**CSV_OPTIONS).option("multiLine", "true").schema(schema).csv(path)
