"""The registered queries against their SQL counterparts, and their shapes."""

from __future__ import annotations

import pytest
from compare import connection, differences

import __spark_entry__ as spark_entry
from orderlens.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_quality": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op6_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op7_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_filter_audit": {
        "part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint",
        "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint",
    },
    "op12_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_result_as_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connection(folder), ORACLE[name]) == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns(spark, folder, name):
    assert dict(QUERIES[name](spark, folder).dtypes) == COLUMNS[name]


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(ORACLE) <= set(spark_entry.oracle_sql())
