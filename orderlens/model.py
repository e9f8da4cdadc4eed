"""Names and limits of the order data model."""

from __future__ import annotations

# Table and column names, accepted codes and limits.
HIST_TABLE = "NEW_ATTRIBUTES_TBL_HIST"
HEADER_TABLE = "SUS_ORDER_TRANS_HDR"
DETAIL_TABLE = "SUS_ORDER_TRANS_DETL"
JOURNAL_TABLE = "SUS_ORDER_JRNL"
JOURNAL_TYPE_TABLE = "SUS_ORDER_JRNL_TYP"
GROUP_TABLE = "SUS_INGRD_FMLY_GRP"

JOURNAL_TYPES = ("Release", "Comment", "First Approval", "Second Approval")
ORDER_STATUSES = ("P", "C", "I")
EXCLUDED_SCORE = -2

COMMENT = "ORDER_JRNL_CMT_TXT"
ORDER = "ORDERNUMBER"
STRENGTH = "ORDERSTRENGTH"
CUMULATIVE = "CUMULSTRENGTH"
GROUP = "INGRD_GRP_NM"
GROUP_ID = "INGRD_GRP_ID"
HEADER_ID = "ORDER_HDR_ID"

LAGS = 12
TREND_MARK = "TREND"
LOAD_ROWS = 1000
CONTEXT_ROWS = 500
PAGE_ROWS = 10
ACTION_ROWS = 10
OUTLINE_GROUPS = 50
OUTLINE_ITEMS = 20
EDGES_READ = 300
EDGES_SHOWN = 100
DENIED_NAME = "sold_to"
SYSTEM_SCHEMAS = ("sys", "INFORMATION_SCHEMA")


def lag_name(k: int) -> str:
    return f"TREND_LAG{k}_STRNT"


# Oldest first: lag 12 down to lag 1.
TREND_COLUMNS = [lag_name(k) for k in range(LAGS, 0, -1)]
LAST_TREND = lag_name(1)
BASE_COLUMNS = [COMMENT, ORDER, STRENGTH, CUMULATIVE, GROUP, *TREND_COLUMNS]


def trend_columns(names: list[str]) -> list[str]:
    """The columns whose name carries the trend mark, in frame order."""
    return [name for name in names if TREND_MARK in name]
