"""Small hand-made order frames."""

from __future__ import annotations

import random

from orderlens import model as m
from orderlens.sources.roles import OrderRoles

FRAME_SCHEMA = ", ".join(
    [
        f"{m.COMMENT} string",
        f"{m.ORDER} bigint",
        f"{m.STRENGTH} double",
        f"{m.CUMULATIVE} double",
        f"{m.GROUP} string",
        *[f"{c} double" for c in m.TREND_COLUMNS],
    ]
)


def row(order, comment="c", group="g", lags=None, last=None, strength=1.0, total=1.0):
    """One frame row; ``lags`` from the oldest to the newest, or ``last`` alone."""
    values = list(lags) if lags is not None else [1.0] * 11 + [last]
    return (comment, order, strength, total, group, *values)


def frame(spark, rows):
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def random_rows(n, orders, groups=("a", "b"), seed=1, comments=("x", "y", "z", None), gaps=0.02, span=6):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        lags = [None if pick.random() < gaps else float(pick.randrange(span)) for _ in range(m.LAGS)]
        rows.append(
            row(pick.choice(orders), pick.choice(comments), pick.choice(groups), lags, strength=float(pick.randrange(9)))
        )
    return rows


def roles(spark, hist, hdr, detl, jrnl, typ, grp) -> OrderRoles:
    lags = [f"{c} double" for c in m.TREND_COLUMNS]
    return OrderRoles(
        spark.createDataFrame(hist, ", ".join([f"{m.ORDER} bigint, {m.GROUP_ID} int, {m.STRENGTH} double, {m.CUMULATIVE} double", *lags])),
        spark.createDataFrame(hdr, f"{m.HEADER_ID} bigint, ORDER_CD bigint"),
        spark.createDataFrame(detl, f"{m.HEADER_ID} bigint, {m.GROUP_ID} int, ORDER_STATUS_CD string, ORDER_SCORE_FCT int"),
        spark.createDataFrame(jrnl, f"{m.HEADER_ID} bigint, {m.GROUP_ID} int, ORDER_JRNL_TYP_ID int, {m.COMMENT} string"),
        spark.createDataFrame(typ, "ORDER_JRNL_TYP_ID int, ORDER_JRNL_TYP_TXT string"),
        spark.createDataFrame(grp, f"{m.GROUP_ID} int, {m.GROUP} string"),
    )


def tuples(df):
    return [tuple(r) for r in df.collect()]


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
