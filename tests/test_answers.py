from __future__ import annotations

import json
import re

import pytest

from orderlens.functions import answers as a

PREDICTIONS = [
    '{"predicted_comment": "c", "reason": "r"}',
    '```json\n{"predicted_comment": "c", "reason": "r"}\n```',
    '  \n{"reason": "r", "predicted_comment": "c", "more": [1, {"x": "}"}]}\n ',
    '{"predicted_comment": "c"}',
    "{}",
    "",
    "   ",
    "no json",
    '{"predicted_comment": "c"} and more',
    '{"predicted_comment": "c"}]',
    '{"predicted_comment": "c"} {"predicted_comment": "d"}',
    '{"predicted_comment": "c"},{"predicted_comment": "d"}',
    "{'predicted_comment': 'c'}",
    '{"predicted_comment": "c",}',
    '{"predicted_comment": "c"',
    '{"predicted_comment": "line\nbreak"}',
    '{"predicted_comment": "line\\nbreak \\u00e9 \\" \\\\"}',
    '{"predicted_comment": "c", "predicted_comment": "last"}',
    '{"predicted_comment": "`` fence ```in``` text"}',
    '{predicted_comment: "c"}',
    '{"predicted_comment": "c" /* note */}',
    '{"predicted_comment": "a", "reason": "b"}] {"c": 1}',
    '{"predicted_comment": "a"}]{}',
    '{"predicted_comment": "a"}} {"predicted_comment": "b"}',
    '{"predicted_comment": "a"}, "v": {"predicted_comment": "b"}',
    '{"predicted_comment": "a"}] [{"predicted_comment": "b"}',
    '{"predicted_comment": "a"}, {"predicted_comment": "b"}] {}',
    '{"predicted_comment": "]}"}',
    '{"predicted_comment": "a"}}',
    '1] {"predicted_comment": "a"}',
    "[1]",
    "null",
    "7",
    '"text"',
    "{",
    "}{",
]


def expected_prediction(text):
    text = re.sub("```", "", re.sub(r"```json\s*", "", text))
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return a.BAD_PREDICTION
    if not isinstance(found, dict):
        return a.BAD_PREDICTION
    return found.get("predicted_comment", ""), found.get("reason", "")


def test_predictions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PREDICTIONS)], "i int, answer string")
    found = {r.i: (r.predicted_comment, r.reason) for r in a.parse_predictions(df, "answer").collect()}
    assert {PREDICTIONS[i]: v for i, v in found.items()} == {t: expected_prediction(t) for t in PREDICTIONS}


def test_missing_answer_and_explicit_null(spark):
    df = spark.createDataFrame([(1, None), (2, '{"predicted_comment": null, "reason": "r"}')], "i int, answer string")
    found = {r.i: (r.predicted_comment, r.reason) for r in a.parse_predictions(df, "answer").collect()}
    assert found == {1: a.BAD_PREDICTION, 2: ("", "r")}


QUERIES = [
    ('{"sql_query": "SELECT 1", "explanation": "e"}', ("SELECT 1", "e")),
    ('```json\n{"sql_query": "SELECT 1"}```', ("SELECT 1", "")),
    ('{"sql_query": "", "explanation": "e"}', (a.NO_SQL, "e")),
    ('{"explanation": "e"}', (a.NO_SQL, "e")),
    ("Here:\n```sql\nselect a\nfrom b\n```\n", ("select a\nfrom b", a.SQL_FOUND)),
    ("SELECT a FROM b  \n\n", ("SELECT a FROM b", a.SQL_FOUND)),
    ('{"sql_query": "SELECT 1"', ('SELECT 1"', a.SQL_FOUND)),
    ("nothing", ("", a.BAD_SQL)),
    ("", ("", a.BAD_SQL)),
    ("[1]", ("", a.NOT_AN_OBJECT)),
    ('["SELECT 1"]', ("", a.NOT_AN_OBJECT)),
    ('"SELECT 1"', ("", a.NOT_AN_OBJECT)),
    ("1] SELECT 2", ("SELECT 2", a.SQL_FOUND)),
    ('"x"] SELECT 2', ("SELECT 2", a.SQL_FOUND)),
    ('{"sql_query": "x"}] select 3 {"y": 1}', ("select 3 {\"y\": 1}", a.SQL_FOUND)),
    ("SELECT", ("", a.BAD_SQL)),
    ("no SELECT or select\n1", ("SELECT or select\n1", a.SQL_FOUND)),
]


@pytest.mark.parametrize("text,expected", QUERIES)
def test_queries(spark, text, expected):
    found = a.extract_queries(spark.createDataFrame([(text,)], "answer string"), "answer").collect()[0]
    assert (found.sql_query, found.explanation) == expected
