"""The registered queries: every operator applied to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.functions.answers import extract_queries, parse_predictions
from orderlens.functions.connections import connection_fields
from orderlens.functions.values import kinds, to_number
from orderlens.operators import approximate, base, context, frames, outline, similar, trends
from orderlens.operators.pages import page_map
from orderlens.operators.search_index import search_index
from orderlens.plans import ask, predict
from orderlens.session import fresh_path, shuffles_released, store
from orderlens.sources import files, texts
from orderlens.sources.catalog import catalog_roles
from orderlens.sources.roles import order_history, order_roles, table, vectors

Query = Callable[[SparkSession, str], DataFrame]

# What the registered searches look for.
BASE_TERM = r"high [an]|^5.*(small|large)$|7\.0$"
PART_TERM = "and#1"
PAGE_NUMBER = 3

# Searches over all groups ask for the orders whose number is divisible by this, against all records.
QUERY_SET = 20

KEYS = [m.ORDER, m.GROUP]
PAGE_KEYS = [frames.Key(m.LAST_TREND, descending=True), frames.Key(m.ORDER), frames.Key(m.GROUP_ID)]


def scan_roles(spark: SparkSession, folder: str) -> DataFrame:
    found = order_roles(spark, folder)
    counts = [
        getattr(found, role).agg(F.count("*").alias("row_count")).select(F.lit(role).alias("role"), "row_count")
        for role in ("hist", "hdr", "detl", "jrnl", "typ", "grp")
    ]
    return reduce(DataFrame.unionAll, counts)


def xml_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return files.parse_companies(texts.company_xml(spark, folder), "xml").drop("xml").orderBy("name")


def extract_kv(spark: SparkSession, folder: str) -> DataFrame:
    return texts.connection_texts(spark, folder).select("s_suppkey", *connection_fields(F.col("conn")))


def catalog_columns(spark: SparkSession, folder: str) -> DataFrame:
    return outline.catalog_columns(catalog_roles(spark, folder)).orderBy(*outline.catalog_order())


def fk_edges(spark: SparkSession, folder: str) -> DataFrame:
    return outline.fk_edges(catalog_roles(spark, folder)).drop("parent_name", "referenced_name")


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    df = base.base_orders(order_roles(spark, folder))
    path = fresh_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


def base_orders(spark: SparkSession, folder: str) -> DataFrame:
    return base.base_orders(order_roles(spark, folder))


def base_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return base.comment_counts(order_roles(spark, folder))


def trend_projection(spark: SparkSession, folder: str) -> DataFrame:
    return frames.trend_projection(base_orders(spark, folder))


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    return base.load_orders(order_roles(spark, folder))


def whole_frame(spark: SparkSession, folder: str) -> DataFrame:
    return base.load_orders(order_roles(spark, folder), None)


_frames: dict[tuple[str, str], DataFrame] = {}


def stored_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The whole frame, stored once per application like the tables it is made of."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _frames:
        frame = whole_frame(spark, folder)
        with shuffles_released(spark):
            _frames[key] = store(frame, "frame")
    return _frames[key]


def load_orders(spark: SparkSession, folder: str) -> DataFrame:
    return base.sorted_frame(loaded(spark, folder))


def action_view(spark: SparkSession, folder: str) -> DataFrame:
    shown = frames.action_view(loaded(spark, folder))
    return shown.toDF("order_no", "ingredient_group", "order_str", "cumul_str", *m.trend_columns(shown.columns))


def _frame_context(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The action orders and the context records of the loaded frame."""
    frame = store(loaded(spark, folder), "frame")
    return frames.last_rows(frame), similar.first_records(frame)


def context_records(spark: SparkSession, folder: str) -> DataFrame:
    selected, records = _frame_context(spark, folder)
    found = context.context_records(selected.select(m.ORDER).distinct(), records)
    values = [F.col("trends")[c].alias(c) for c in m.TREND_COLUMNS]
    return found.select("query_order", "place", "order_number", "comment", *values)


def context_json(spark: SparkSession, folder: str) -> DataFrame:
    return context.context_json(*_frame_context(spark, folder))


def search_any_column(spark: SparkSession, folder: str) -> DataFrame:
    return frames.search(base_orders(spark, folder), BASE_TERM)


def search_literal(spark: SparkSession, folder: str) -> DataFrame:
    return frames.search(table(spark, folder, "part"), PART_TERM, literal=True)


def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as ``search_any_column``, found through an index."""
    return search_index(base_orders(spark, folder)).search(BASE_TERM)


def search_page(spark: SparkSession, folder: str) -> DataFrame:
    df = whole_frame(spark, folder)
    return frames.search_page(df, BASE_TERM, PAGE_NUMBER, base.frame_order(df.columns))


def order_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return frames.first_rows(whole_frame(spark, folder))


def clean_trends(spark: SparkSession, folder: str) -> DataFrame:
    df = base.base_orders(texts.with_text_trends(order_roles(spark, folder)))
    return base.sorted_frame(base.clean_trends(df))


def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    df = texts.number_texts(spark, folder)
    return df.select("c_custkey", to_number(F.col("value"), kinds(df)["value"]).alias("number"))


def deny_columns(spark: SparkSession, folder: str) -> DataFrame:
    return frames.deny_columns(
        table(spark, folder, "orders").select(
            "o_orderkey", F.col("o_custkey").alias("Sold_To_Id"), "o_totalprice", F.col("o_orderstatus").alias("SOLD_TO_STATUS")
        )
    )


def role_join(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")

    def place(end: str) -> DataFrame:
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias(f"{end}_key"),
            F.col("n_name").alias(f"{end}_nation"),
            F.col("r_name").alias(f"{end}_region"),
        )

    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(place("customer"), F.col("c_nationkey") == F.col("customer_key"))
        .join(place("supplier"), F.col("s_nationkey") == F.col("supplier_key"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "customer_nation",
            "customer_region",
            "supplier_nation",
            "supplier_region",
        )
    )


def correlated_count(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per customer, 0 if none: lines are counted per order before any join."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    per_customer = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("n").alias("n"))
    )
    return (
        table(spark, folder, "customer")
        .select("c_custkey")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_lines"))
    )


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return outline.schema_groups(outline.catalog_columns(catalog_roles(spark, folder)))


def outline_groups(spark: SparkSession, folder: str) -> DataFrame:
    names = F.concat_ws(",", F.transform("items", lambda x: x["column_name"]))
    return _groups(spark, folder).select("group_rank", "full_name", "n_items", "n_more", names.alias("first_items"))


def outline_lines(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline_lines(_groups(spark, folder))


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return outline.edge_lines(outline.fk_edges(catalog_roles(spark, folder)))


def schema_outline(spark: SparkSession, folder: str) -> DataFrame:
    found = catalog_roles(spark, folder)
    return outline.schema_outline("orders", outline.catalog_columns(found), outline.fk_edges(found))


def limit_then_filter(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return outline.limit_then_filter(orders, order, m.EDGES_READ, F.col("o_orderstatus") != "F")


def result_profile(spark: SparkSession, folder: str) -> DataFrame:
    return frames.profile(base_orders(spark, folder))


def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return frames.page_count(whole_frame(spark, folder))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return order_history(spark, folder)[1]


def lag_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select(m.ORDER, m.GROUP_ID, *m.TREND_COLUMNS)


def cumulative_strength(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select(m.ORDER, m.GROUP_ID, m.STRENGTH, m.CUMULATIVE)


def top_comments(spark: SparkSession, folder: str) -> DataFrame:
    return base.top_comments(base_orders(spark, folder))


def page_offset(spark: SparkSession, folder: str) -> DataFrame:
    df = loaded(spark, folder)
    return frames.page(df, PAGE_NUMBER, base.frame_order(df.columns))


def page_keyset(spark: SparkSession, folder: str) -> DataFrame:
    """The page after page 2, continued from that page's last row."""
    df = base.clean_trends(_history(spark, folder))
    before = frames.page(df, PAGE_NUMBER - 1, [key.sort for key in PAGE_KEYS]).collect()
    last = [before[-1][key.name] for key in PAGE_KEYS] if before else [None] * len(PAGE_KEYS)
    return frames.page_after(df, PAGE_KEYS, last)


def page_late(spark: SparkSession, folder: str) -> DataFrame:
    """The page four fifths of the way through the whole frame, read through its page map."""
    df = stored_frame(spark, folder)
    pages = page_map(df, base.frame_order(df.columns))
    number = pages.page_count() * 4 // 5
    return pages.page(number).withColumn("page_number", F.lit(number).cast("long"))


def parse_answers(spark: SparkSession, folder: str) -> DataFrame:
    return parse_predictions(texts.prediction_answers(spark, folder), "answer").drop("answer")


def extract_sql(spark: SparkSession, folder: str) -> DataFrame:
    return extract_queries(texts.query_answers(spark, folder), "answer").drop("answer")


def trend_features(spark: SparkSession, folder: str) -> DataFrame:
    hist = _history(spark, folder).select(m.ORDER, m.GROUP_ID, *m.TREND_COLUMNS)
    return trends.trend_features(hist).drop(*m.TREND_COLUMNS)


def trend_shape(spark: SparkSession, folder: str) -> DataFrame:
    hist = _history(spark, folder).select(m.ORDER, m.GROUP_ID, *m.TREND_COLUMNS)
    return trends.shaped(hist).drop(*m.TREND_COLUMNS)


def pattern_comments(spark: SparkSession, folder: str) -> DataFrame:
    return trends.pattern_comments(whole_frame(spark, folder))


def pattern_association(spark: SparkSession, folder: str) -> DataFrame:
    return trends.pattern_association(stored_frame(spark, folder))


def knn_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest records of all groups, for every group of the orders in the query set."""
    queries = vectors(order_roles(spark, folder)).filter(f"{m.ORDER} % {QUERY_SET} = 0")
    return similar.neighbour_rows(similar.nearest_orders(queries, stored_frame(spark, folder)), KEYS)


def knn_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest records of all groups, for every order and group, by hashed buckets: some of the nearest may be missing."""
    queries = vectors(order_roles(spark, folder))
    return similar.neighbour_rows(approximate.nearest_hashed(queries, stored_frame(spark, folder)), KEYS)


def knn_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest records of the order's own group, for every order and group."""
    queries = vectors(order_roles(spark, folder))
    return similar.neighbour_rows(similar.nearest_orders(queries, stored_frame(spark, folder), [m.GROUP]), KEYS)


def predict_comment(spark: SparkSession, folder: str) -> DataFrame:
    return predict.predict_from_frame(order_roles(spark, folder), QUERY_SET, stored_frame(spark, folder))


def prediction_batch(spark: SparkSession, folder: str) -> DataFrame:
    return predict.prediction_batch(order_roles(spark, folder), stored_frame(spark, folder))


def predict_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    frame = stored_frame(spark, folder)
    return similar.prediction_accuracy(predict.prediction_batch(order_roles(spark, folder), frame), frame)


# The registered SQL texts.
TOP_ORDERS_SQL = """
SELECT ORDERNUMBER AS order_number, INGRD_GRP_ID AS group_id, ORDERSTRENGTH AS order_strength
FROM NEW_ATTRIBUTES_TBL_HIST
ORDER BY ORDERSTRENGTH DESC, ORDERNUMBER, INGRD_GRP_ID
LIMIT 10
"""
JOIN_CAP_SQL = """
-- strongest scored orders of each group
SELECT h.ORDER_CD AS order_number, g.INGRD_GRP_NM AS group_name, d.ORDER_SCORE_FCT AS score,
       d.ORDERSTRENGTH AS order_strength
FROM SUS_ORDER_TRANS_DETL d
JOIN SUS_ORDER_TRANS_HDR h ON h.ORDER_HDR_ID = d.ORDER_HDR_ID
JOIN SUS_INGRD_FMLY_GRP g ON g.INGRD_GRP_ID = d.INGRD_GRP_ID
WHERE d.ORDER_STATUS_CD = 'C' AND d.ORDER_SCORE_FCT >= 5
ORDER BY order_strength DESC, order_number, group_name
LIMIT 100
"""
ENVELOPE_SQL = [
    ("rows", "SELECT ORDER_HDR_ID, h.o_custkey AS sold_to_customer, ORDER_CD FROM SUS_ORDER_TRANS_HDR h;"),
    ("no rows", "SELECT * FROM SUS_ORDER_JRNL WHERE ORDER_JRNL_TYP_ID < 0"),
    ("error", "SELECT missing_column FROM SUS_ORDER_JRNL"),
    ("no query", ""),
    ("command", "DROP VIEW SUS_ORDER_JRNL"),
    ("unsafe function", "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS home"),
    ("no context", "SELECT 1 AS one"),
]


def adhoc_top_orders(spark: SparkSession, folder: str) -> DataFrame:
    ask.register(order_roles(spark, folder))
    return ask.select(spark, TOP_ORDERS_SQL)


def adhoc_join_cap(spark: SparkSession, folder: str) -> DataFrame:
    ask.register(order_roles(spark, folder))
    return ask.select(spark, JOIN_CAP_SQL)


def adhoc_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """One row per outcome of running a query."""
    ask.register(order_roles(spark, folder))
    rows = []
    for label, sql in ENVELOPE_SQL:
        outcome = ask.run_query(spark, sql, "orders", context=None if label == "no context" else "")
        rows.append(
            (label, outcome.success, outcome.message, outcome.summary, outcome.row_count, outcome.column_count)
        )
    return spark.createDataFrame(
        rows,
        "outcome string, success boolean, message string, summary string, row_count bigint, column_count bigint",
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        load_orders,
        scan_roles,
        xml_ingest,
        extract_kv,
        catalog_columns,
        fk_edges,
        csv_roundtrip,
        base_orders,
        base_fanout,
        trend_projection,
        action_view,
        context_records,
        context_json,
        search_any_column,
        search_literal,
        search_indexed,
        search_page,
        order_lookup,
        clean_trends,
        coerce_numeric,
        deny_columns,
        role_join,
        correlated_count,
        outline_groups,
        outline_lines,
        edge_lines,
        schema_outline,
        limit_then_filter,
        result_profile,
        page_count,
        lag_vectors,
        cumulative_strength,
        top_comments,
        page_offset,
        page_keyset,
        page_late,
        parse_answers,
        extract_sql,
        trend_features,
        trend_shape,
        pattern_comments,
        pattern_association,
        knn_orders,
        knn_blocked,
        knn_lsh,
        predict_comment,
        prediction_batch,
        predict_accuracy,
        adhoc_top_orders,
        adhoc_join_cap,
        adhoc_envelope,
    )
}
