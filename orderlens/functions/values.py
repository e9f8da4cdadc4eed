"""Column expressions for numbers and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(col: Column, kind: T.DataType) -> Column:
    """A double; text that is no finite number, and NaN, become NULL."""
    if isinstance(kind, T.StringType):
        # The cast ignores outer white space.
        value = F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value)
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def has_number(col: Column, kind: T.DataType) -> Column:
    """Whether ``to_number`` gives a value.

    Kept apart from ``to_number``: a filter that repeats the expressions of
    twelve computed columns makes the optimizer derive a constraint for every
    mix of them.
    """
    if isinstance(kind, T.StringType):
        size = F.abs(col.try_cast("double"))
        return F.coalesce(col.rlike(NUMBER_PATTERN) & (size < float("inf")), F.lit(False))
    return col.isNotNull() & ~F.isnan(col.cast("double"))


def text_form(col: Column, kind: T.DataType) -> Column:
    """The text a search sees.

    Doubles are written plainly from 1e-4 up to 1e16 and as ``1e+16`` or
    ``1e-05`` beyond, where Spark's own cast starts exponents at 1e7 and 1e-3.
    """
    text = col.cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(col)
    plain = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_replace(text, r"(\.0)?E(-?)(\d+)$", "e$2$3")
    exponent = F.regexp_replace(exponent, r"e(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(F.isnan(col) | (size == float("inf")) | (col == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in df.schema.fields}
