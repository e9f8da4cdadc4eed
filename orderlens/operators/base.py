"""The order relation: six-table join, cleaning and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.functions.values import has_number, kinds, to_number
from orderlens.sources.roles import OrderRoles


def _text_in(name: str, values: Sequence[str], ignore_case: bool) -> Column:
    col = F.collate(F.col(name), "UTF8_LCASE") if ignore_case else F.col(name)
    return col.isin(*values)


def accepted_journal(roles: OrderRoles, types: Sequence[str] = m.JOURNAL_TYPES, ignore_case: bool = False) -> DataFrame:
    """Journal rows of the accepted types, cut down before any large join."""
    kept = roles.typ.filter(_text_in("ORDER_JRNL_TYP_TXT", types, ignore_case)).select("ORDER_JRNL_TYP_ID")
    return roles.jrnl.join(kept, "ORDER_JRNL_TYP_ID").select(m.HEADER_ID, m.GROUP_ID, m.COMMENT)


def accepted_detail(
    roles: OrderRoles, statuses: Sequence[str] = m.ORDER_STATUSES, score: int = m.EXCLUDED_SCORE, ignore_case: bool = False
) -> DataFrame:
    """Detail rows in an accepted status; a NULL score is dropped like the excluded one."""
    return roles.detl.filter(
        _text_in("ORDER_STATUS_CD", statuses, ignore_case) & (F.col("ORDER_SCORE_FCT") != score)
    ).select(m.HEADER_ID, m.GROUP_ID)


def base_orders(
    roles: OrderRoles,
    types: Sequence[str] = m.JOURNAL_TYPES,
    statuses: Sequence[str] = m.ORDER_STATUSES,
    score: int = m.EXCLUDED_SCORE,
    ignore_case: bool = False,
) -> DataFrame:
    """One row per accepted comment, with the strengths and trend of its order and group.

    Header, detail and journal are joined first: narrow rows, one per comment.
    They meet the history last, so its wide rows are shuffled once, and never
    the wider ones that a join of them gives. Both joins with the journal's
    rows have two freshly shuffled sides, the form in which adaptive execution
    can split the rows of an order that has a large part of all comments.
    """
    named = roles.hdr.select(m.HEADER_ID, F.col("ORDER_CD").alias(m.ORDER)).join(
        accepted_detail(roles, statuses, score, ignore_case), m.HEADER_ID
    )
    noted = named.join(accepted_journal(roles, types, ignore_case), [m.HEADER_ID, m.GROUP_ID])
    return roles.hist.join(noted, [m.ORDER, m.GROUP_ID]).join(roles.grp, m.GROUP_ID).select(*m.BASE_COLUMNS)


def comment_counts(roles: OrderRoles) -> DataFrame:
    """Accepted comments per order and group, counted before the join."""
    counts = accepted_journal(roles).groupBy(m.HEADER_ID, m.GROUP_ID).agg(F.count("*").alias("n_comments"))
    return (
        roles.hdr.select(m.HEADER_ID, "ORDER_CD")
        .join(accepted_detail(roles), m.HEADER_ID)
        .join(counts, [m.HEADER_ID, m.GROUP_ID])
        .select(F.col("ORDER_CD").alias(m.ORDER), m.GROUP_ID, "n_comments")
    )


def load_order(names: list[str]) -> list[Column]:
    """Comment descending, missing comments last; every other column breaks ties."""
    return [F.desc_nulls_last(m.COMMENT)] + [F.asc_nulls_last(n) for n in names if n != m.COMMENT]


def frame_order(names: list[str]) -> list[Column]:
    """Lag 1 descending, missing last, if there is one; every other column breaks ties."""
    first = [F.desc_nulls_last(m.LAST_TREND)] if m.LAST_TREND in names else []
    rest = [n for n in (m.ORDER, m.GROUP, m.COMMENT) if n in names]
    rest += [n for n in names if n not in rest and n != m.LAST_TREND]
    return first + [F.asc_nulls_last(n) for n in rest]


def top_comments(df: DataFrame, n: int | None = m.LOAD_ROWS) -> DataFrame:
    """The first ``n`` rows by comment descending; all rows if ``n`` is None."""
    ranked = df.orderBy(*load_order(df.columns))
    return df if n is None else ranked.limit(n)


def numeric_trends(df: DataFrame) -> DataFrame:
    """Trend columns as doubles, with junk as NULL."""
    types = kinds(df)
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in m.trend_columns(df.columns)})


def clean_trends(df: DataFrame) -> DataFrame:
    """Numeric trends, without rows that have none."""
    types = kinds(df)
    some = [has_number(F.col(c), types[c]) for c in m.trend_columns(df.columns)]
    return numeric_trends(df.filter(reduce(or_, some)) if some else df)


def load_orders(roles: OrderRoles, n: int | None = m.LOAD_ROWS) -> DataFrame:
    """The cleaned order frame; see ``frame_order`` for its row order."""
    return clean_trends(top_comments(base_orders(roles), n))


def sorted_frame(df: DataFrame) -> DataFrame:
    return df.orderBy(*frame_order(df.columns))
