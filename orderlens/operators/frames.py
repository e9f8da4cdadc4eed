"""Searching, paging, looking up and profiling a frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.functions.values import kinds, text_form
from orderlens.operators.base import frame_order


class InvalidPattern(ValueError):
    """The search term is no valid regular expression."""


def search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Rows where the text of any column contains ``term``, ignoring case.

    ``term`` is a regular expression unless ``literal``. NULL never matches;
    an empty term keeps every row.
    """
    if not term:
        return df
    if not literal:
        check_pattern(df, term)

    # Columns of one type share one condition: written out for each of them, it makes code too long to be compiled.
    alike: dict[Any, list[Column]] = {}
    for name, kind in kinds(df).items():
        alike.setdefault(kind, []).append(F.col(f"`{name}`"))

    def hit(columns: list[Column], kind: Any) -> Column:
        found = F.exists(F.array(*columns), lambda x: F.coalesce(holds(text_form(x, kind), term, literal), F.lit(False)))
        return F.coalesce(found, F.lit(False))

    return df.filter(reduce(or_, [hit(columns, kind) for kind, columns in alike.items()]))


def holds(text: Column, term: str, literal: bool) -> Column:
    """Whether a text holds the term, ignoring case."""
    return F.lower(text).contains(term.lower()) if literal else text.rlike(f"(?iu){term}")


def check_pattern(df: DataFrame, term: str) -> None:
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(f"(?iu){term}")).collect()
    except PySparkException as error:
        raise InvalidPattern(f"not a valid search pattern: {term}") from error


def page(df: DataFrame, number: int, order: Sequence[Column], size: int = m.PAGE_ROWS) -> DataFrame:
    """Page ``number`` (from 0); a page past the end is empty.

    ``order`` should tell all rows apart. Every task keeps the rows of the
    pages before this one; use ``page_after`` to walk far.
    """
    return df.orderBy(*order).offset(number * size).limit(size)


@dataclass(frozen=True)
class Key:
    """One sort column of a keyset; NULL comes last in either direction."""

    name: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        return F.desc_nulls_last(self.name) if self.descending else F.asc_nulls_last(self.name)

    def after(self, value: Any) -> Column:
        col = F.col(self.name)
        if value is None:
            return F.lit(False)
        return col.isNull() | ((col < F.lit(value)) if self.descending else (col > F.lit(value)))


def page_after(df: DataFrame, keys: Sequence[Key], last: Sequence[Any], size: int = m.PAGE_ROWS) -> DataFrame:
    """The ``size`` rows that follow the row with key values ``last``.

    The key must be unique. The cost does not grow with the distance from
    the start, as the filter reaches the scan.
    """
    later = F.lit(False)
    for key, value in zip(reversed(keys), reversed(last)):
        later = key.after(value) | (F.col(key.name).eqNullSafe(F.lit(value)) & later)
    return df.filter(later).orderBy(*[key.sort for key in keys]).limit(size)


def page_count(df: DataFrame, size: int = m.PAGE_ROWS) -> DataFrame:
    """Row count and page count, the last page possibly being short."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.ceil(F.col("row_count") / size).cast("long").alias("page_count")
    )


def search_page(
    df: DataFrame, term: str, number: int, order: Sequence[Column], literal: bool = False, size: int = m.PAGE_ROWS
) -> DataFrame:
    """One page of the search result, with the result's row and page counts.

    The page is fetched at once (``size`` rows), and the result is counted in
    passing: rows are observed on their way into the cut.
    """
    seen = Observation()
    counted = search(df, term, literal).observe(seen, F.count(F.lit(1)).alias("row_count"))
    rows = page(counted, number, order, size).collect()
    total = seen.get["row_count"]
    counts = {"row_count": F.lit(total).cast("long"), "page_count": F.lit(-(-total // size)).cast("long")}
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema).withColumns(counts)


def last_rows(df: DataFrame, n: int = m.ACTION_ROWS) -> DataFrame:
    """The last ``n`` rows in frame order, found as the first of the reverse order."""
    trailing = [F.asc_nulls_first(m.LAST_TREND)] if m.LAST_TREND in df.columns else []
    rest = [c for c in (m.ORDER, m.GROUP, m.COMMENT) if c in df.columns]
    rest += [c for c in df.columns if c not in rest and c != m.LAST_TREND]
    trailing += [F.desc_nulls_first(c) for c in rest]
    return df.orderBy(*trailing).limit(n).orderBy(*frame_order(df.columns))


def action_view(df: DataFrame, n: int = m.ACTION_ROWS) -> DataFrame:
    """The last rows under their display names."""
    trends = m.trend_columns(df.columns)
    shown = [m.ORDER, m.GROUP, m.STRENGTH, m.CUMULATIVE, *trends]
    # Display names.
    titles = ["Order #", "Ingredient Group", "Order Str", "Cumul. Str"]
    return last_rows(df, n).select(*shown).toDF(*titles, *trends)


def trend_projection(df: DataFrame) -> DataFrame:
    return df.select(*m.trend_columns(df.columns))


def order_lookup(df: DataFrame, number: Any) -> DataFrame:
    """The first row of one order in frame order; empty if there is none."""
    return df.filter(F.col(m.ORDER) == number).orderBy(*frame_order(df.columns)).limit(1)


def first_rows(df: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The first row in frame order of every order, or of the orders in ``queries``.

    A minimum over a struct that is sorted like the frame, so a hot order is
    reduced inside each task before anything is shuffled.
    """
    wanted = df if queries is None else df.join(queries.select(m.ORDER).distinct(), m.ORDER, "left_semi")
    names = df.columns
    rest = [c for c in (m.GROUP, m.COMMENT) if c in names]
    rest += [c for c in names if c not in rest and c not in (m.LAST_TREND, m.ORDER)]
    rank: list[Column] = []
    if m.LAST_TREND in names:
        rank += [F.col(m.LAST_TREND).isNull().alias("r0"), F.negative(m.LAST_TREND).alias("r1")]
    for i, name in enumerate(rest):
        rank += [F.col(name).isNull().alias(f"m{i}"), F.col(name).alias(f"v{i}")]
    first = wanted.groupBy(m.ORDER).agg(F.min(F.struct(*rank)).alias("r"))
    values = {name: F.col(f"r.v{i}") for i, name in enumerate(rest)}
    values[m.LAST_TREND] = F.negative("r.r1")
    values[m.ORDER] = F.col(m.ORDER)
    return first.select(*[values[name].alias(name) for name in names])


def profile(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(df.columns)).cast("long").alias("column_count"))


def allowed_columns(names: Sequence[str], denied: str = m.DENIED_NAME) -> list[str]:
    return [name for name in names if denied.lower() not in name.lower()]


def deny_columns(df: DataFrame, denied: str = m.DENIED_NAME) -> DataFrame:
    """Without the columns whose name contains ``denied``, whatever its case.

    Works by position, so that repeated column names are kept.
    """
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    kept = [i for i, name in enumerate(names) if denied.lower() not in name.lower()]
    return numbered.select(*[f"c{i}" for i in kept]).toDF(*[names[i] for i in kept])
