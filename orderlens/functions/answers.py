"""Parsing text answers that should hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fences, error texts and placeholders.
FENCE_START = r"```json\s*"
FENCE = "```"
OBJECT_PATTERN = r"(?s)^\s*\{.*\}\s*$"
# The first SELECT that something follows, to the end of the text.
SELECT_PATTERN = r"(?is)select.+"
SPACES = " \t\n\r\f\u000b"
BAD_PREDICTION = ("Error: Could not generate prediction", "Failed to parse AI response into JSON format")
NO_SQL = "-- Could not generate a valid SQL query"
SQL_FOUND = "SQL query extracted from non-JSON response."
BAD_SQL = "Failed to parse AI response. Please try a different query."
NOT_AN_OBJECT = "Error: the answer is not a JSON object"

# JSON as the standard has it; the defaults also take single quotes.
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FENCE_START, ""), FENCE, "")


def _only_value(text: Column, schema: str) -> Column:
    """The one JSON value in ``text`` read with ``schema``; NULL if there is not exactly one.

    The reader ignores whatever follows a complete value, so the text is read
    inside an array and inside an object: text that closes one of them early
    breaks the other.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{schema}>", _STRICT)
    named = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{schema}>", _STRICT)
    return F.when((F.size(listed) == 1) & named["v"].isNotNull(), F.get(listed, F.lit(0)))


def _object(text: Column, schema: str) -> Column:
    return F.when(text.rlike(OBJECT_PATTERN), _only_value(text, schema))


def parse_predictions(df: DataFrame, answer: str) -> DataFrame:
    """Add ``predicted_comment`` and ``reason`` read from the answer column.

    A missing field is empty text; an answer that is not one JSON object
    gives the fixed error pair.
    """
    text = strip_fences(F.col(answer))
    found = df.withColumn("_found", _object(text, "struct<predicted_comment:string,reason:string>"))
    known = F.col("_found").isNotNull()

    def field(name: str, error: str) -> Column:
        return F.when(known, F.coalesce(F.col(f"_found.{name}"), F.lit(""))).otherwise(error)

    return found.select(
        *df.columns,
        field("predicted_comment", BAD_PREDICTION[0]).alias("predicted_comment"),
        field("reason", BAD_PREDICTION[1]).alias("reason"),
    )


def extract_queries(df: DataFrame, answer: str) -> DataFrame:
    """Add ``sql_query`` and ``explanation`` read from the answer column.

    Answers that are no JSON may still hold a SELECT, taken up to the end of
    the text.
    """
    text = strip_fences(F.col(answer))
    found = df.select(
        "*",
        _object(text, "struct<sql_query:string,explanation:string>").alias("_found"),
        _only_value(text, "string").isNotNull().alias("_json"),
        F.nullif(F.btrim(F.regexp_extract(text, SELECT_PATTERN, 0), F.lit(SPACES)), F.lit("")).alias("_select"),
    )
    known = F.col("_found").isNotNull()
    query = (
        F.when(known, F.coalesce(F.nullif(F.col("_found.sql_query"), F.lit("")), F.lit(NO_SQL)))
        .when(F.col("_json"), "")
        .otherwise(F.coalesce("_select", F.lit("")))
    )
    explanation = (
        F.when(known, F.coalesce(F.col("_found.explanation"), F.lit("")))
        .when(F.col("_json"), NOT_AN_OBJECT)
        .when(F.col("_select").isNotNull(), SQL_FOUND)
        .otherwise(BAD_SQL)
    )
    return found.select(*df.columns, query.alias("sql_query"), explanation.alias("explanation"))
