"""DuckDB SQL that gives the same result as each registered query."""

from __future__ import annotations

from orderlens import model as m
from orderlens.functions import answers as a
from orderlens.operators import outline as o
from orderlens.plans import ask
from orderlens.operators.trends import CHANCE_LIMIT, LEAST_EXPECTED
from orderlens.plans import registry as r
from orderlens.sources.roles import JOURNAL_TYPE_ROWS

LAG_LIST = ", ".join(m.TREND_COLUMNS)
BASE_LIST = ", ".join(m.BASE_COLUMNS)


def _quoted(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


ORDER_TABLES = f"""
grp AS (SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) AS INGRD_GRP_ID, p_brand AS INGRD_GRP_NM FROM part),
hdr AS (SELECT o_orderkey AS ORDER_HDR_ID, o_orderkey + 500000 AS ORDER_CD, o_custkey, o_orderdate FROM orders),
typ AS (SELECT * FROM (VALUES {", ".join(str(row) for row in JOURNAL_TYPE_ROWS)})
        AS t(ORDER_JRNL_TYP_ID, ORDER_JRNL_TYP_TXT)),
detl AS (
  SELECT o_orderkey AS ORDER_HDR_ID, CAST(substring(p_brand, 7) AS INT) AS INGRD_GRP_ID,
         MIN(CASE o_orderstatus WHEN 'P' THEN 'P' WHEN 'O' THEN 'C' ELSE 'X' END) AS ORDER_STATUS_CD,
         CASE WHEN MAX(l_discount) > 0.095 THEN -2 ELSE CAST(ROUND(MAX(l_discount) * 100) AS INT) END AS ORDER_SCORE_FCT,
         SUM(l_quantity) AS ORDERSTRENGTH
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
hist AS (
  SELECT ORDER_CD AS ORDERNUMBER, INGRD_GRP_ID, ORDERSTRENGTH,
         SUM(ORDERSTRENGTH) OVER (w ROWS UNBOUNDED PRECEDING) AS CUMULSTRENGTH,
         {", ".join(f"LAG(ORDERSTRENGTH, {k}) OVER w AS {m.lag_name(k)}" for k in range(m.LAGS, 0, -1))}
  FROM detl JOIN hdr USING (ORDER_HDR_ID) JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY c_nationkey, INGRD_GRP_ID ORDER BY o_orderdate, ORDER_CD)),
jrnl AS (
  SELECT o_orderkey AS ORDER_HDR_ID, CAST(substring(p_brand, 7) AS INT) AS INGRD_GRP_ID,
         l_linenumber AS ORDER_JRNL_TYP_ID,
         CASE WHEN l_tax = 0 THEN NULL ELSE concat(o_orderpriority, ' ', l_returnflag, ' ', p_type) END AS ORDER_JRNL_CMT_TXT
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""

BASE = f"""{ORDER_TABLES},
kept_detl AS (
  SELECT ORDER_HDR_ID, INGRD_GRP_ID FROM detl
  WHERE ORDER_STATUS_CD IN ({_quoted(m.ORDER_STATUSES)}) AND ORDER_SCORE_FCT <> {m.EXCLUDED_SCORE}),
kept_jrnl AS (
  SELECT ORDER_HDR_ID, INGRD_GRP_ID, ORDER_JRNL_CMT_TXT FROM jrnl SEMI JOIN (
    SELECT ORDER_JRNL_TYP_ID FROM typ WHERE ORDER_JRNL_TYP_TXT IN ({_quoted(m.JOURNAL_TYPES)})) USING (ORDER_JRNL_TYP_ID)),
base AS (
  SELECT {BASE_LIST}
  FROM kept_jrnl JOIN kept_detl USING (ORDER_HDR_ID, INGRD_GRP_ID)
  JOIN (SELECT ORDER_HDR_ID, ORDER_CD AS ORDERNUMBER FROM hdr) USING (ORDER_HDR_ID)
  JOIN hist USING (ORDERNUMBER, INGRD_GRP_ID) JOIN grp USING (INGRD_GRP_ID))"""

LOAD_ORDER = "ORDER_JRNL_CMT_TXT DESC NULLS LAST, " + ", ".join(
    f"{c} NULLS LAST" for c in m.BASE_COLUMNS if c != m.COMMENT
)
FRAME_ORDER = "TREND_LAG1_STRNT DESC NULLS LAST, " + ", ".join(
    f"{c} NULLS LAST"
    for c in [m.ORDER, m.GROUP, m.COMMENT, m.STRENGTH, m.CUMULATIVE, *m.TREND_COLUMNS[:-1]]
)
SOME_TREND = f"coalesce({LAG_LIST}) IS NOT NULL"
ALL_TRENDS = " AND ".join(f"{c} IS NOT NULL" for c in m.TREND_COLUMNS)

WHOLE = f"""{BASE},
whole AS (SELECT * FROM base WHERE {SOME_TREND})"""
FRAME = f"""{BASE},
frame AS (SELECT * FROM (SELECT * FROM base ORDER BY {LOAD_ORDER} LIMIT {m.LOAD_ROWS}) WHERE {SOME_TREND})"""
# Numbered frame rows, and the numbers of each order's own rows.
FRAME_CONTEXT = f"""{FRAME},
ctx AS (SELECT *, row_number() OVER (ORDER BY {FRAME_ORDER}) AS pos FROM frame),
own AS (SELECT ORDERNUMBER, list(pos) AS places FROM ctx GROUP BY ORDERNUMBER)"""
QUERIES_CTE = f"vec AS (SELECT ORDERNUMBER, INGRD_GRP_NM, {LAG_LIST} FROM hist JOIN grp USING (INGRD_GRP_ID))"
DISTANCE = " + ".join(f"(q.{c} - c.{c}) * (q.{c} - c.{c})" for c in m.TREND_COLUMNS)


def _neighbours(source: str, asked: str, block: str) -> str:
    """The five nearest of all commented records of other orders."""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in m.TREND_COLUMNS)
    return f"""{QUERIES_CTE},
asked AS (SELECT * FROM vec WHERE {asked}),
near AS (
  SELECT q.ORDERNUMBER, q.INGRD_GRP_NM,
         arg_min({{'o': c.ORDERNUMBER, 'c': c.ORDER_JRNL_CMT_TXT, 'd': {DISTANCE}}}, ({DISTANCE}, c.ORDERNUMBER, c.ORDER_JRNL_CMT_TXT), 5) AS best
  FROM (SELECT * FROM asked WHERE {complete}) q
  JOIN (SELECT * FROM {source} WHERE ORDER_JRNL_CMT_TXT IS NOT NULL AND {complete}) c
    ON {block} c.ORDERNUMBER <> q.ORDERNUMBER
  GROUP BY 1, 2),
knn AS (
  SELECT ORDERNUMBER, INGRD_GRP_NM, x.o AS neighbour_order, x.c AS neighbour_comment, x.d AS distance, CAST(rank AS INT) AS rank
  FROM (SELECT ORDERNUMBER, INGRD_GRP_NM, unnest(best) AS x, generate_subscripts(best, 1) AS rank FROM near))"""


KNN_FRAME = f"{WHOLE},\n{_neighbours('whole', f'ORDERNUMBER % {r.QUERY_SET} = 0', '')}"
KNN_GROUP = f"{WHOLE},\n{_neighbours('whole', 'true', 'c.INGRD_GRP_NM = q.INGRD_GRP_NM AND')}"


def _features(source: str, keep: str) -> str:
    """Sums over the present lags, and what follows from them."""
    t = {c: i for i, c in enumerate(m.TREND_COLUMNS)}

    def total(part: str) -> str:
        return " + ".join(part.format(c=c, t=t[c]) for c in m.TREND_COLUMNS)

    return f"""sums AS (
  SELECT {keep}, TREND_LAG1_STRNT AS trend_last, least({LAG_LIST}) AS trend_min, greatest({LAG_LIST}) AS trend_max,
         {total("({c} IS NOT NULL)::INT")} AS n_lags,
         {total("({c} IS NOT NULL)::INT * {t}")} AS st,
         {total("({c} IS NOT NULL)::INT * {t} * {t}")} AS stt,
         {total("coalesce({c}, 0)")} AS sy,
         {total("coalesce({c} * {c}, 0)")} AS syy,
         {total("coalesce({c} * {t}, 0)")} AS sty
  FROM {source}),
means AS (SELECT *, CASE WHEN n_lags > 0 THEN sy / n_lags END AS trend_mean FROM sums),
features AS (
  SELECT {keep}, n_lags, trend_mean, trend_min, trend_max, trend_last, trend_last - trend_mean AS last_minus_mean,
         CASE WHEN n_lags > 0 THEN sqrt(greatest(0.0, syy / n_lags - trend_mean * trend_mean)) END AS trend_stddev,
         CASE WHEN n_lags * stt - st * st > 0 THEN (n_lags * sty - st * sy) / (n_lags * stt - st * st) END AS trend_slope
  FROM means),
shapes AS (
  SELECT *, CASE WHEN n_lags < 6 THEN 'missing'
                 WHEN trend_slope * 11 > 0.5 * trend_mean THEN 'rising'
                 WHEN -trend_slope * 11 > 0.5 * trend_mean THEN 'falling'
                 WHEN trend_last > trend_mean + 2.0 * trend_stddev THEN 'spike'
                 ELSE 'flat' END AS shape
  FROM features)"""


def _patterns(source: str) -> str:
    """Comment counts per shape of the rows of ``source``."""
    text = _features(source, "ORDER_JRNL_CMT_TXT")
    for name in ("sums", "means", "features", "shapes"):
        text = text.replace(f"{name} AS (", f"p_{name} AS (").replace(f"FROM {name})", f"FROM p_{name})")
    return f"""{text},
patterns AS (
  SELECT shape, ORDER_JRNL_CMT_TXT AS comment, count(*) AS n,
         CAST(row_number() OVER (PARTITION BY shape ORDER BY count(*) DESC, ORDER_JRNL_CMT_TXT) AS INT) AS rank,
         count(*) / SUM(count(*)) OVER (PARTITION BY shape) AS share
  FROM p_shapes WHERE ORDER_JRNL_CMT_TXT IS NOT NULL GROUP BY 1, 2)"""


def _predictions(source: str) -> str:
    return f"""{_features("asked", "ORDERNUMBER, INGRD_GRP_NM")},
{_patterns(source)},
ballots AS (
  SELECT ORDERNUMBER, INGRD_GRP_NM, neighbour_comment, count(*) AS votes, SUM(distance) AS total,
         string_agg(CAST(neighbour_order AS VARCHAR), ', ' ORDER BY rank) AS orders,
         SUM(count(*)) OVER (PARTITION BY ORDERNUMBER, INGRD_GRP_NM) AS asked
  FROM knn GROUP BY 1, 2, 3),
won AS (
  SELECT * FROM ballots QUALIFY row_number() OVER (
    PARTITION BY ORDERNUMBER, INGRD_GRP_NM ORDER BY votes DESC, total, neighbour_comment) = 1),
predictions AS (
  SELECT s.ORDERNUMBER, s.INGRD_GRP_NM,
         coalesce(w.neighbour_comment, p.comment, 'Error: No data available for prediction') AS predicted_comment,
         CASE WHEN w.votes IS NOT NULL
              THEN concat(w.votes, ' of ', CAST(w.asked AS BIGINT), ' similar orders carry this comment: ', w.orders)
              WHEN p.comment IS NOT NULL THEN concat('no similar order; most common comment of shape ', s.shape)
              ELSE 'Failed to generate prompt due to missing or empty data' END AS reason
  FROM shapes s LEFT JOIN won w USING (ORDERNUMBER, INGRD_GRP_NM)
  LEFT JOIN patterns p ON p.shape = s.shape AND p.rank = 1)"""


CATALOG_TABLES = """
m_schemas AS (SELECT n_nationkey AS schema_id, CASE WHEN n_nationkey = 0 THEN 'sys' ELSE n_name END AS name FROM nation),
m_tables AS (
  SELECT s_suppkey AS object_id, CASE WHEN s_suppkey % 17 = 3 THEN '#' || s_name ELSE s_name END AS name,
         s_nationkey AS schema_id, CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS is_ms_shipped FROM supplier),
m_types AS (SELECT * FROM (VALUES (0, 'bigint'), (1, 'varchar'), (2, 'float'), (3, 'datetime'), (4, 'int'))
            AS t(user_type_id, name)),
m_columns AS (
  SELECT DISTINCT l_suppkey AS object_id, l_partkey + 1 AS column_id,
         CASE WHEN p_size = 50 THEN 'SOLD_TO_' ELSE 'c_' END || l_partkey AS name,
         l_partkey % 5 AS user_type_id, p_size AS max_length, l_partkey % 2 AS is_nullable
  FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber, l_extendedprice) AS line FROM lineitem),
pairs AS (
  SELECT x.l_orderkey, x.l_suppkey AS parent, x.l_partkey AS parent_part, y.l_suppkey AS referenced,
         y.l_partkey AS referenced_part
  FROM numbered x JOIN numbered y USING (l_orderkey) WHERE x.line = 1 AND y.line = 2),
smallest AS (SELECT object_id, MIN(column_id) AS column_id FROM m_columns GROUP BY 1),
m_fk AS (SELECT l_orderkey AS object_id, 'FK_' || l_orderkey AS name, parent AS parent_object_id,
                referenced AS referenced_object_id FROM pairs),
m_fkc AS (
  SELECT l_orderkey AS constraint_object_id, parent AS parent_object_id, parent_part + 1 AS parent_column_id,
         referenced AS referenced_object_id, referenced_part + 1 AS referenced_column_id FROM pairs
  UNION ALL
  SELECT l_orderkey, parent, p.column_id, referenced, q.column_id
  FROM pairs JOIN smallest p ON p.object_id = parent JOIN smallest q ON q.object_id = referenced
  WHERE l_orderkey % 5 = 0),
places AS (
  SELECT object_id, m_tables.name AS table_name, m_schemas.name AS schema_name
  FROM m_tables JOIN m_schemas USING (schema_id) WHERE is_ms_shipped = 0),
links AS (
  SELECT parent_object_id AS object_id, count(*) AS n FROM m_fkc
  WHERE constraint_object_id IN (SELECT object_id FROM m_fk) GROUP BY 1),
named AS (
  SELECT object_id, column_id, schema_name, table_name, name AS column_name, user_type_id, max_length, is_nullable,
         contains(lower(name), 'sold_to') AS denied
  FROM m_columns JOIN places USING (object_id)),
listed AS (
  SELECT schema_name, table_name, column_name, m_types.name AS data_type, max_length, is_nullable = 1 AS is_nullable,
         coalesce(n, 0) AS has_relationships, column_id
  FROM named JOIN m_types USING (user_type_id) LEFT JOIN links USING (object_id)
  WHERE schema_name NOT IN ('sys', 'INFORMATION_SCHEMA') AND NOT starts_with(table_name, '#') AND NOT denied),
edges AS (
  SELECT m_fk.name AS fk_name, a.schema_name || '.' || a.table_name AS parent_table, a.column_name AS parent_column,
         b.schema_name || '.' || b.table_name AS referenced_table, b.column_name AS referenced_column,
         a.table_name AS parent_name, b.table_name AS referenced_name, a.denied OR b.denied AS denied
  FROM m_fkc JOIN m_fk ON m_fk.object_id = constraint_object_id
  JOIN named a ON (a.object_id, a.column_id) = (m_fkc.parent_object_id, parent_column_id)
  JOIN named b ON (b.object_id, b.column_id) = (m_fkc.referenced_object_id, referenced_column_id)),
fk_edges AS (
  SELECT * FROM (SELECT * FROM edges ORDER BY parent_name, referenced_name, fk_name, parent_column, referenced_column,
                                              parent_table, referenced_table LIMIT 300)
  WHERE NOT denied)"""

OUTLINE = f"""{CATALOG_TABLES},
sized AS (
  SELECT schema_name || '.' || table_name AS full_name, count(*) AS n_items,
         CAST(row_number() OVER (ORDER BY count(*) DESC, MAX(has_relationships) DESC, MIN(table_name),
                                 schema_name || '.' || table_name) AS INT) AS group_rank
  FROM listed GROUP BY 1 QUALIFY group_rank <= 50),
items AS (
  SELECT group_rank, full_name, n_items, column_name, data_type, is_nullable,
         CAST(row_number() OVER (PARTITION BY full_name ORDER BY column_id, column_name) AS INT) AS place
  FROM listed JOIN sized ON full_name = schema_name || '.' || table_name QUALIFY place <= 20),
outline_lines AS (
  SELECT group_rank, 0 AS line_no, printf('{o.GROUP_LINE}', full_name) AS line FROM sized
  UNION ALL
  SELECT group_rank, place, printf('{o.ITEM_LINE}', column_name, data_type,
         CASE WHEN is_nullable THEN '{o.NULLABLE}' ELSE '{o.NOT_NULLABLE}' END) FROM items
  UNION ALL
  SELECT group_rank, 21, printf('{o.MORE_ITEMS}', n_items - 20) FROM sized WHERE n_items > 20),
edge_lines AS (
  SELECT row_number() OVER (ORDER BY parent_name, referenced_name, fk_name, parent_column, referenced_column,
                            parent_table, referenced_table) AS line_no,
         printf('{o.EDGE_LINE}', parent_table, parent_column, referenced_table, referenced_column) AS line
  FROM fk_edges QUALIFY line_no <= 100
  UNION ALL
  SELECT 101, printf('{o.MORE_EDGES}', count(*) - 100) FROM fk_edges HAVING count(*) > 100)"""


def _search(columns: list[str], test: str) -> str:
    return " OR ".join(f"coalesce({test.format(x=f'CAST({c} AS VARCHAR)')}, false)" for c in columns)


BASE_MATCH = _search(m.BASE_COLUMNS, f"regexp_matches({{x}}, '{r.BASE_TERM}', 'i')")
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_MATCH = _search(PART_COLUMNS, f"contains(lower({{x}}), '{r.PART_TERM}')")

TEXT_LAGS = ", ".join(
    f"CASE WHEN ORDERNUMBER % 11 = 0 THEN 'n/a' WHEN ORDERNUMBER % 13 = 0 THEN ' ' || CAST({c} AS VARCHAR) "
    f"ELSE CAST({c} AS VARCHAR) END AS {c}"
    for c in m.TREND_COLUMNS
)
CLEAN_LAGS = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in m.TREND_COLUMNS)

RECORD_JSON = (
    "'{\"order_number\":' || c.ORDERNUMBER || ',\"comment\":' || coalesce(to_json(c.ORDER_JRNL_CMT_TXT)::VARCHAR, 'null') || ',\"trends\":{' || "
    + " || ',' || ".join(f"'\"{c}\":' || coalesce(CAST(c.{c} AS VARCHAR), 'null')" for c in m.TREND_COLUMNS)
    + " || '}}'"
)
TREND_JSON = (
    "'{' || "
    + " || ',' || ".join(f"'\"{c}\":' || coalesce(CAST(q.{c} AS VARCHAR), 'null')" for c in m.TREND_COLUMNS)
    + " || '}'"
)
LAST_TEN = f"""last_ten AS (SELECT * FROM frame ORDER BY {", ".join(
    part.replace(" DESC NULLS LAST", " ASC NULLS FIRST") if "DESC" in part else part.replace(" NULLS LAST", " DESC NULLS FIRST")
    for part in FRAME_ORDER.split(", "))} LIMIT {m.ACTION_ROWS})"""
CONTEXT_JOIN = f"""LEFT JOIN own o USING (ORDERNUMBER)
JOIN ctx c ON c.ORDERNUMBER <> q.ORDERNUMBER
 AND c.pos - coalesce(len(list_filter(o.places, lambda p: p < c.pos)), 0) <= {m.CONTEXT_ROWS}"""

KEYSET_ORDER = "TREND_LAG1_STRNT DESC NULLS LAST, ORDERNUMBER, INGRD_GRP_ID"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE: dict[str, str] = {
    "load_orders": f"WITH {FRAME} SELECT * FROM frame",
    "scan_roles": f"WITH {ORDER_TABLES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS role, count(*) AS row_count FROM {name}"
        for name in ("hist", "hdr", "detl", "jrnl", "typ", "grp")
    ),
    "xml_ingest": """
SELECT s_suppkey, s_name AS name, 'srv' || s_nationkey AS server FROM supplier WHERE s_suppkey % 4 <> 3""",
    "extract_kv": """
SELECT s_suppkey, s_name AS server, 'db' || s_nationkey AS "database", 'u' || s_suppkey AS username,
       CASE WHEN s_suppkey % 2 = 0 THEN 'p w' END AS password FROM supplier""",
    "catalog_columns": f"WITH {CATALOG_TABLES} SELECT * FROM listed",
    "fk_edges": f"WITH {CATALOG_TABLES} SELECT fk_name, parent_table, parent_column, referenced_table, referenced_column FROM fk_edges",
    "csv_roundtrip": f"WITH {BASE} SELECT * FROM base",
    "base_orders": f"WITH {BASE} SELECT * FROM base",
    "base_fanout": f"""WITH {BASE}
SELECT ORDER_HDR_ID + 500000 AS ORDERNUMBER, INGRD_GRP_ID, count(*) AS n_comments
FROM kept_jrnl JOIN kept_detl USING (ORDER_HDR_ID, INGRD_GRP_ID) GROUP BY 1, 2""",
    "trend_projection": f"WITH {BASE} SELECT {LAG_LIST} FROM base",
    "action_view": f"""WITH {FRAME}, {LAST_TEN}
SELECT ORDERNUMBER AS order_no, INGRD_GRP_NM AS ingredient_group, ORDERSTRENGTH AS order_str,
       CUMULSTRENGTH AS cumul_str, {LAG_LIST} FROM last_ten""",
    "context_records": f"""WITH {FRAME_CONTEXT}, {LAST_TEN}
SELECT q.ORDERNUMBER AS query_order,
       CAST(row_number() OVER (PARTITION BY q.ORDERNUMBER ORDER BY c.pos) AS INT) AS place,
       c.ORDERNUMBER AS order_number, c.ORDER_JRNL_CMT_TXT AS comment, {", ".join(f"c.{c}" for c in m.TREND_COLUMNS)}
FROM (SELECT DISTINCT ORDERNUMBER FROM last_ten) q {CONTEXT_JOIN}""",
    "context_json": f"""WITH {FRAME_CONTEXT}, {LAST_TEN}
SELECT q.ORDERNUMBER AS order_number, q.base_orders, {TREND_JSON} AS trends
FROM (SELECT q.*, (SELECT '[' || string_agg({RECORD_JSON}, ',' ORDER BY c.pos) || ']' FROM ctx c
                   WHERE c.ORDERNUMBER <> q.ORDERNUMBER
                     AND c.pos - coalesce(len(list_filter(o.places, lambda p: p < c.pos)), 0) <= {m.CONTEXT_ROWS}) AS base_orders
      FROM last_ten q LEFT JOIN own o USING (ORDERNUMBER)) q""",
    "search_any_column": f"WITH {BASE} SELECT * FROM base WHERE {BASE_MATCH}",
    "search_indexed": f"WITH {BASE} SELECT * FROM base WHERE {BASE_MATCH}",
    "search_literal": f"SELECT * FROM part WHERE {PART_MATCH}",
    "search_page": f"""WITH {WHOLE}, found AS (SELECT * FROM whole WHERE {BASE_MATCH})
SELECT *, (SELECT count(*) FROM found) AS row_count, (SELECT CAST(ceil(count(*) / 10) AS BIGINT) FROM found) AS page_count
FROM found ORDER BY {FRAME_ORDER} LIMIT {m.PAGE_ROWS} OFFSET {r.PAGE_NUMBER * m.PAGE_ROWS}""",
    "order_lookup": f"""WITH {WHOLE}
SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY ORDERNUMBER ORDER BY {FRAME_ORDER}) = 1""",
    "clean_trends": f"""WITH {BASE},
texts AS (SELECT * REPLACE ({TEXT_LAGS}) FROM base),
numbers AS (SELECT * REPLACE ({CLEAN_LAGS}) FROM texts)
SELECT * FROM numbers WHERE {SOME_TREND}""",
    "coerce_numeric": """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 12.0::DOUBLE WHEN 1 THEN 12.0 WHEN 2 THEN 100000.0 END AS number FROM customer""",
    "deny_columns": "SELECT o_orderkey, o_totalprice FROM orders",
    "role_join": """
SELECT l_orderkey, l_linenumber, l_partkey, cn.n_name AS customer_nation, cr.r_name AS customer_region,
       sn.n_name AS supplier_nation, sr.r_name AS supplier_region
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""",
    "correlated_count": """
SELECT c_custkey, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey
                   WHERE o_custkey = c.c_custkey) AS n_lines FROM customer c""",
    "outline_groups": f"""WITH {OUTLINE}
SELECT group_rank, full_name, n_items, greatest(n_items - 20, 0) AS n_more,
       string_agg(column_name, ',' ORDER BY place) AS first_items FROM items GROUP BY 1, 2, 3, 4""",
    "outline_lines": f"WITH {OUTLINE} SELECT * FROM outline_lines",
    "edge_lines": f"WITH {OUTLINE} SELECT * FROM edge_lines",
    "schema_outline": f"""WITH {OUTLINE},
blocks AS (SELECT group_rank, string_agg(line, chr(10) ORDER BY line_no) || chr(10) || chr(10) AS block
           FROM outline_lines GROUP BY 1)
SELECT {_lit(o.OUTLINE_HEAD.format(database="orders"))}
       || (SELECT string_agg(block, '' ORDER BY group_rank) FROM blocks)
       || {_lit(o.EDGES_HEAD)}
       || (SELECT string_agg(line || chr(10), '' ORDER BY line_no) FROM edge_lines) AS outline""",
    "limit_then_filter": f"""
SELECT * FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey
               LIMIT {m.EDGES_READ}) WHERE o_orderstatus <> 'F'""",
    "result_profile": f"WITH {BASE} SELECT count(*) AS row_count, CAST(17 AS BIGINT) AS column_count FROM base",
    "page_count": f"WITH {WHOLE} SELECT count(*) AS row_count, CAST(ceil(count(*) / 10) AS BIGINT) AS page_count FROM whole",
    "lag_vectors": f"WITH {ORDER_TABLES} SELECT ORDERNUMBER, INGRD_GRP_ID, {LAG_LIST} FROM hist",
    "cumulative_strength": f"WITH {ORDER_TABLES} SELECT ORDERNUMBER, INGRD_GRP_ID, ORDERSTRENGTH, CUMULSTRENGTH FROM hist",
    "top_comments": f"WITH {BASE} SELECT * FROM base ORDER BY {LOAD_ORDER} LIMIT {m.LOAD_ROWS}",
    "page_offset": f"WITH {FRAME} SELECT * FROM frame ORDER BY {FRAME_ORDER} LIMIT {m.PAGE_ROWS} OFFSET {r.PAGE_NUMBER * m.PAGE_ROWS}",
    "page_keyset": f"""WITH {ORDER_TABLES} SELECT * FROM hist WHERE {SOME_TREND}
ORDER BY {KEYSET_ORDER} LIMIT {m.PAGE_ROWS} OFFSET {r.PAGE_NUMBER * m.PAGE_ROWS}""",
    "page_late": f"""WITH {WHOLE},
numbered AS (SELECT *, (row_number() OVER (ORDER BY {FRAME_ORDER}) - 1) // {m.PAGE_ROWS} AS page_number FROM whole),
late AS (SELECT CAST(ceil(count(*) / {m.PAGE_ROWS}) AS BIGINT) * 4 // 5 AS late FROM whole)
SELECT {BASE_LIST}, page_number FROM numbered JOIN late ON page_number = late""",
    "parse_answers": f"""
WITH clean AS (SELECT doc_id, source, replace(regexp_replace(text, '```json\\s*', '', 'g'), '```', '') AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 8 < 3 THEN text ELSE {_lit(a.BAD_PREDICTION[0])} END AS predicted_comment,
       CASE WHEN doc_id % 8 < 2 THEN source WHEN doc_id % 8 = 2 THEN '' ELSE {_lit(a.BAD_PREDICTION[1])} END AS reason
FROM clean""",
    "extract_sql": f"""
WITH clean AS (SELECT doc_id, source, replace(regexp_replace(text, '```json\\s*', '', 'g'), '```', '') AS text FROM documents)
SELECT doc_id,
       CASE doc_id % 5 WHEN 0 THEN 'SELECT ''' || replace(text, '''', '''''') || ''' AS t'
                       WHEN 1 THEN {_lit(a.NO_SQL)}
                       WHEN 2 THEN 'select ''' || source || ''' as s'
                       WHEN 3 THEN 'SELECT ''' || replace(text, '''', '''''') || ''' AS t' ELSE '' END AS sql_query,
       CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source WHEN 4 THEN {_lit(a.BAD_SQL)}
                       ELSE {_lit(a.SQL_FOUND)} END AS explanation
FROM clean""",
    "trend_features": f"""WITH {ORDER_TABLES}, {_features("hist", "ORDERNUMBER, INGRD_GRP_ID")}
SELECT ORDERNUMBER, INGRD_GRP_ID, n_lags, trend_mean, trend_stddev, trend_min, trend_max, trend_last, last_minus_mean,
       trend_slope FROM features""",
    "trend_shape": f"""WITH {ORDER_TABLES}, {_features("hist", "ORDERNUMBER, INGRD_GRP_ID")}
SELECT ORDERNUMBER, INGRD_GRP_ID, shape FROM shapes""",
    "pattern_comments": f"WITH {WHOLE}, {_patterns('whole')} SELECT shape, rank, comment, n, share FROM patterns WHERE rank <= 5",
    "pattern_association": f"""WITH {WHOLE}, {_features("whole", "ORDER_JRNL_CMT_TXT, INGRD_GRP_NM")},
rows AS (SELECT INGRD_GRP_NM, shape, ORDER_JRNL_CMT_TXT AS comment FROM shapes WHERE ORDER_JRNL_CMT_TXT IS NOT NULL),
pairs AS (SELECT INGRD_GRP_NM, shape, comment, count(*) AS n FROM rows GROUP BY ALL),
sides AS (
  SELECT *, CAST(SUM(n) OVER (PARTITION BY INGRD_GRP_NM, shape) AS DOUBLE) AS s,
         CAST(SUM(n) OVER (PARTITION BY INGRD_GRP_NM, comment) AS DOUBLE) AS c,
         CAST(SUM(n) OVER (PARTITION BY INGRD_GRP_NM) AS DOUBLE) AS t FROM pairs),
tested AS (
  SELECT *, s * c / t AS expected, n::DOUBLE * t / (s * c) AS lift,
         CASE WHEN s * (t - s) * c * (t - c) > 0
              THEN t * (n::DOUBLE * t - s * c) * (n::DOUBLE * t - s * c) / (s * (t - s) * c * (t - c)) END AS chi_square
  FROM sides)
SELECT INGRD_GRP_NM, shape, comment, n, expected, lift, chi_square,
       coalesce(n > expected AND expected >= {LEAST_EXPECTED} AND chi_square > {CHANCE_LIMIT}, false) AS consistent
FROM tested""",
    "knn_orders": f"""WITH {KNN_FRAME}
SELECT ORDERNUMBER, INGRD_GRP_NM, rank, neighbour_order, neighbour_comment, distance FROM knn""",
    "knn_blocked": f"""WITH {KNN_GROUP}
SELECT ORDERNUMBER, INGRD_GRP_NM, rank, neighbour_order, neighbour_comment, distance FROM knn""",
    "predict_comment": f"WITH {KNN_FRAME}, {_predictions('whole')} SELECT * FROM predictions",
    "prediction_batch": f"WITH {KNN_GROUP}, {_predictions('whole')} SELECT * FROM predictions",
    "predict_accuracy": f"""WITH {KNN_GROUP}, {_predictions('whole')}
SELECT INGRD_GRP_NM, count(*) AS n_comments,
       count(*) FILTER (WHERE ORDER_JRNL_CMT_TXT = predicted_comment) AS n_equal,
       count(*) FILTER (WHERE ORDER_JRNL_CMT_TXT = predicted_comment) / count(*) AS share
FROM whole JOIN predictions USING (ORDERNUMBER, INGRD_GRP_NM) WHERE ORDER_JRNL_CMT_TXT IS NOT NULL GROUP BY 1""",
    "adhoc_top_orders": f"""WITH {ORDER_TABLES}
SELECT ORDERNUMBER AS order_number, INGRD_GRP_ID AS group_id, ORDERSTRENGTH AS order_strength
FROM hist ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "adhoc_join_cap": f"""WITH {ORDER_TABLES}
SELECT ORDER_CD AS order_number, INGRD_GRP_NM AS group_name, ORDER_SCORE_FCT AS score, ORDERSTRENGTH AS order_strength
FROM detl JOIN hdr USING (ORDER_HDR_ID) JOIN grp USING (INGRD_GRP_ID)
WHERE ORDER_STATUS_CD = 'C' AND ORDER_SCORE_FCT >= 5 ORDER BY 4 DESC, 1, 2 LIMIT 100""",
    "adhoc_envelope": f"""
SELECT 'rows' AS outcome, true AS success, 'Found ' || count(*) || ' records matching your query.' AS message,
       'Found ' || count(*) || ' records with 2 columns.' || chr(10) || chr(10) || 'This shows: orders' AS summary,
       count(*) AS row_count, CAST(2 AS BIGINT) AS column_count FROM orders
UNION ALL SELECT 'no rows', true, {_lit(ask.NOTHING_FOUND)}, {_lit(ask.NOTHING_SUMMARY)}, 0, 4
UNION ALL SELECT 'error', false, {_lit(ask.QUERY_FAILED)}, NULL, NULL, NULL
UNION ALL SELECT 'no query', false, {_lit(ask.NO_QUERY)}, NULL, NULL, NULL
UNION ALL SELECT 'command', false, {_lit(ask.QUERY_FAILED)}, NULL, NULL, NULL
UNION ALL SELECT 'unsafe function', false, {_lit(ask.QUERY_FAILED)}, NULL, NULL, NULL
UNION ALL SELECT 'no context', false, {_lit(ask.NO_CONTEXT)}, NULL, NULL, NULL""",
}
