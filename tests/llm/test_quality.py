from __future__ import annotations

import itertools
import random
import sys
import time

import brute
import odd
import pytest
from pyspark import cloudpickle

from orderlens.llm import quality
from orderlens.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def expected(rows):
    out = []
    for d, t in rows:
        m = brute.measures(t)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out.append((d, *(m[n] for n in names), brute.base_failed(m), brute.good(t)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("rejected_by").collect()), key=repr)


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(quality.measure_and_judge(docs)) == expected(rows)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    assert got(quality.measure_and_judge(docs)) == expected([(r[0], r[1]) for r in odd.DOC_ROWS])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        ((r[0], r[1]) for r in odd.DOC_ROWS if brute.good(r[1])), key=repr
    )


def test_no_rows(spark):
    empty = odd.documents(spark, [])
    assert quality.measure_and_judge(empty).collect() == []
    assert quality.keep_good(empty).collect() == []


def test_repeated_windows_of_random_texts():
    pick = random.Random(2)
    for _ in range(300):
        text = " ".join(pick.choice("ab") * pick.randrange(1, 3) for _ in range(pick.randrange(30)))
        assert quality.Measures(text).n_repeat_words == brute.measures(text)["n_repeat_words"]


def slow(m):
    time.sleep(0.002)
    return m.n_words > 2


RULES = [
    quality.Rule("never", lambda m: False),
    quality.Rule("slow", slow),
    quality.Rule("fast", lambda m: m.n_words > 2),
    quality.Rule("seldom", lambda m: time.sleep(0.0005) or m.n_words > 95),
]


def test_rules_run_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(" ".join("w" * n),) for n in range(100)], "text string")
    names = [r.name for r in quality.ordered(docs, RULES)]
    assert names[0] == "fast" and names[-1] == "never" and names.index("slow") < names.index("seldom")


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:6])
def test_order_does_not_change_what_is_kept(order):
    rules = [RULES[2], quality.MORE_RULES[0], quality.MORE_RULES[1]]
    for row in odd.DOC_ROWS:
        m = quality.Measures(row[1])
        first = quality.first_rejection(m, [rules[i] for i in order])
        assert (first is None) == (quality.first_rejection(m, rules) is None)


def test_the_cascade_stops_at_the_first_rejection():
    seen = []
    rules = [quality.Rule(n, lambda m, n=n: seen.append(n) or n == "b") for n in "abc"]
    assert quality.first_rejection(quality.Measures("x"), rules) == "b" and seen == ["a", "b"]


def test_labelled_good_documents_are_kept(spark, folder):
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    rows = quality.measure_and_judge(table(spark, folder, "documents")).collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad)
