"""Text inputs derived from the star schema: answers, XML, connection strings, numbers as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.sources.roles import OrderRoles, table


def prediction_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per document, in eight shapes; valid ones carry the whole text."""
    shape = F.col("doc_id") % 8
    both = F.to_json(F.struct(F.col("text").alias("predicted_comment"), F.col("source").alias("reason")))
    one = F.to_json(F.struct(F.col("text").alias("predicted_comment")))
    answer = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), both, F.lit("\n```")))
        .when(shape == 1, both)
        .when(shape == 2, one)
        .when(shape == 3, F.concat(F.lit("no json "), "text"))
        .when(shape == 4, F.concat(both, F.lit(" and more")))
        .when(shape == 5, "[1]")
        .when(shape == 6, "")
        .otherwise(F.concat(both, F.lit(" "), both))
    )
    return table(spark, folder, "documents").select("doc_id", answer.alias("answer"))


def query_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One query answer per document, in five shapes."""
    shape = F.col("doc_id") % 5
    quoted = F.concat(F.lit("SELECT '"), F.regexp_replace("text", "'", "''"), F.lit("' AS t"))
    answer = (
        F.when(shape == 0, F.to_json(F.struct(quoted.alias("sql_query"), F.col("source").alias("explanation"))))
        .when(shape == 1, F.to_json(F.struct(F.lit("").alias("sql_query"), F.col("source").alias("explanation"))))
        .when(shape == 2, F.concat(F.lit("Here it is:\n```sql\nselect '"), "source", F.lit("' as s\n```\n")))
        .when(shape == 3, F.concat(quoted, F.lit(" \n")))
        .otherwise(F.concat(F.lit("none for "), "source"))
    )
    return table(spark, folder, "documents").select("doc_id", answer.alias("answer"))


def company_xml(spark: SparkSession, folder: str) -> DataFrame:
    """One configuration element per supplier, in four shapes; the last has no server."""
    shape = F.col("s_suppkey") % 4
    server = F.concat(F.lit("srv"), F.col("s_nationkey").cast("string"))
    fields = F.struct(
        F.when(shape.isin(0, 3), F.col("s_name")).alias("Name"),
        F.when(shape.isin(1, 2), F.col("s_name")).alias("n"),
        F.when(shape < 2, server).when(shape == 2, "").alias("ServerName"),
        F.when(shape == 2, F.concat(F.lit("Data Source="), server, F.lit(";Initial Catalog=db"))).alias(
            "ConnectionString"
        ),
    )
    return table(spark, folder, "supplier").select("s_suppkey", F.to_xml(fields).alias("xml"))


def connection_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One connection string per supplier; odd keys have no password."""
    parts = [
        F.lit("Data Source="),
        F.col("s_name"),
        F.lit(";Initial Catalog=db"),
        F.col("s_nationkey").cast("string"),
        F.lit(";user id=u"),
        F.col("s_suppkey").cast("string"),
        F.when(F.col("s_suppkey") % 2 == 0, ";Password=p w").otherwise(""),
    ]
    return table(spark, folder, "supplier").select("s_suppkey", F.concat(*parts).alias("conn"))


# Number texts by customer key modulo 8; the eighth is NULL.
NUMBER_TEXTS = ("12", " 12 ", "1e5", "1,000", "abc", "", "1d")


def number_texts(spark: SparkSession, folder: str) -> DataFrame:
    shape = F.col("c_custkey") % 8
    text = F.lit(None).cast("string")
    for i, value in enumerate(NUMBER_TEXTS):
        text = F.when(shape == i, value).otherwise(text)
    return table(spark, folder, "customer").select("c_custkey", text.alias("value"))


def with_text_trends(roles: OrderRoles) -> OrderRoles:
    """The order tables with lags as text: some junk, some padded."""
    number = F.col(m.ORDER)
    as_text = {
        c: F.when(number % 11 == 0, "n/a")
        .when(number % 13 == 0, F.concat(F.lit(" "), F.col(c).cast("string")))
        .otherwise(F.col(c).cast("string"))
        for c in m.TREND_COLUMNS
    }
    return OrderRoles(roles.hist.withColumns(as_text), roles.hdr, roles.detl, roles.jrnl, roles.typ, roles.grp)
