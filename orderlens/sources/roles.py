"""The six order tables, read from a database or derived from a star schema."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.model import COMMENT, CUMULATIVE, GROUP, GROUP_ID, HEADER_ID, ORDER, STRENGTH, TREND_COLUMNS
from orderlens.operators.series import with_history
from orderlens.session import shuffles_released, store, store_only

# Journal types 1 to 7 of the derived tables.
JOURNAL_TYPE_ROWS = [
    (1, "Release"),
    (2, "Comment"),
    (3, "First Approval"),
    (4, "Second Approval"),
    (5, "Hold"),
    (6, "Reject"),
    (7, "Note"),
]
ORDER_CODE_OFFSET = 500000
HISTORY_SERIES = ["c_nationkey", GROUP_ID]
HISTORY_ORDER = ["o_orderdate", "ORDER_CD"]


@dataclass(frozen=True)
class OrderRoles:
    """The order tables, whatever they were read from."""

    hist: DataFrame
    hdr: DataFrame
    detl: DataFrame
    jrnl: DataFrame
    typ: DataFrame
    grp: DataFrame


_built: dict[tuple[str, str], OrderRoles] = {}
_histories: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def group_id() -> F.Column:
    return F.substring("p_brand", 7, 20).cast("int").alias(GROUP_ID)


def header(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(HEADER_ID),
        (F.col("o_orderkey") + ORDER_CODE_OFFSET).alias("ORDER_CD"),
        "o_custkey",
        "o_orderdate",
    )


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(group_id(), F.col("p_brand").alias(GROUP)).distinct()


def journal_types(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({number}, '{text}')" for number, text in JOURNAL_TYPE_ROWS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ORDER_JRNL_TYP_ID, ORDER_JRNL_TYP_TXT)")


def detail(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order and group, with the series keys of the history.

    Lines are dealt out by order once: their sums per order and group and the
    join with orders both use that. Customers meet orders, not lines, so lines
    move no second time where customers are too many to be broadcast.
    """
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part").select("p_partkey", group_id()), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", GROUP_ID, "l_discount", "l_quantity")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", GROUP_ID)
        .agg(F.max("l_discount").alias("discount"), F.sum("l_quantity").alias(STRENGTH))
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = F.when(F.col("o_orderstatus") == "P", "P").when(F.col("o_orderstatus") == "O", "C").otherwise("X")
    score = F.when(F.col("discount") > 0.095, -2).otherwise(F.round(F.col("discount") * 100).cast("int"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias(HEADER_ID),
            (F.col("l_orderkey") + ORDER_CODE_OFFSET).alias("ORDER_CD"),
            GROUP_ID,
            status.alias("ORDER_STATUS_CD"),
            score.alias("ORDER_SCORE_FCT"),
            STRENGTH,
            "o_orderdate",
            "c_custkey",
            "c_nationkey",
        )
    )


def history(detl: DataFrame) -> DataFrame:
    """Strength, running strength and 12 lags per order and group."""
    return with_history(
        detl.filter(F.col("c_custkey").isNotNull()).select(
            F.col("ORDER_CD"), GROUP_ID, STRENGTH, "o_orderdate", "c_nationkey"
        ),
        HISTORY_SERIES,
        HISTORY_ORDER,
        STRENGTH,
        running=CUMULATIVE,
    ).select(F.col("ORDER_CD").alias(ORDER), GROUP_ID, STRENGTH, CUMULATIVE, *TREND_COLUMNS)


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """One comment per order line."""
    text = F.concat("o_orderpriority", F.lit(" "), "l_returnflag", F.lit(" "), "p_type")
    return (
        table(spark, folder, "lineitem")
        .join(
            table(spark, folder, "part").select("p_partkey", group_id(), "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(
            table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .select(
            F.col("l_orderkey").alias(HEADER_ID),
            GROUP_ID,
            F.col("l_linenumber").alias("ORDER_JRNL_TYP_ID"),
            F.when(F.col("l_tax") == 0, None).otherwise(text).alias(COMMENT),
        )
    )


def order_history(spark: SparkSession, folder: str, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Detail and history of the star schema in ``folder``, for queries that read no journal.

    Stored tables, written once per application to the shared folder;
    ``refresh`` writes them again.
    """
    key = (spark.sparkContext.applicationId, folder)
    if refresh or key not in _histories:
        with shuffles_released(spark):
            detl = store(detail(spark, folder), "detl")
            _histories[key] = detl, store_only(spark, "hist", lambda: history(detl))[0]
    return _histories[key]


def order_roles(spark: SparkSession, folder: str, refresh: bool = False) -> OrderRoles:
    """The six tables derived from the star schema in ``folder``.

    History, detail and journal are stored tables, written once per
    application to the shared folder; ``refresh`` writes them again.
    """
    key = (spark.sparkContext.applicationId, folder)
    if refresh or key not in _built:
        detl, hist = order_history(spark, folder, refresh)
        with shuffles_released(spark):
            jrnl = store(journal(spark, folder), "jrnl")
        _built[key] = OrderRoles(
            hist=hist,
            hdr=header(spark, folder),
            detl=detl.select(HEADER_ID, GROUP_ID, "ORDER_STATUS_CD", "ORDER_SCORE_FCT", STRENGTH),
            jrnl=jrnl,
            typ=journal_types(spark),
            grp=groups(spark, folder),
        )
    return _built[key]


def vectors(roles: OrderRoles) -> DataFrame:
    """One trend vector per order and group, named like the frame's columns."""
    return roles.hist.join(roles.grp, GROUP_ID).select(ORDER, GROUP, *TREND_COLUMNS)


def stored(roles: OrderRoles) -> OrderRoles:
    """Copies of the six tables in the shared folder, read from the source once."""
    return OrderRoles(*[store(getattr(roles, f.name), f.name) for f in fields(roles)])
