from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import odd
import pytest

from orderlens.llm import lexical_search
from orderlens.llm.lexical_search import Best, List, build_index, count_terms, rank_segment, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    """(item_id, rank, doc_id, score), every document scored for every item."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    holding = Counter(term for _, c in counted for term in c)
    out = []
    for item_id, text in set(items):
        asked, scores = Counter(terms(text)), []
        for d, c in counted:
            m = 75 + 25 * c.total() * n // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=20):
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, term string")
    return sorted((tuple(r) for r in search(build_index(docs), asked, k).collect()), key=repr)


ITEMS = [(1, "one TWO three two"), (2, None), (3, ""), (4, odd.PASSAGE), (4, odd.PASSAGE), (4, "another text"), (5, "nowhereatall"), (None, "words words é 한국어"), (6, odd.LONG)]


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in odd.DOC_ROWS]
    got = searched(spark, odd.documents(spark), ITEMS)
    assert got == brute(docs, ITEMS)
    assert any(r[2] is None for r in got)


def test_no_rows(spark):
    assert searched(spark, odd.documents(spark, []), ITEMS) == []
    assert searched(spark, odd.documents(spark), [(1, "zzzz")]) == []
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert search(build_index(odd.documents(spark)), nothing).collect() == []


@pytest.mark.parametrize("postings, pairs", [(50, 10), (100_000, 1_000_000)])
def test_random_texts(spark, monkeypatch, postings, pairs):
    """Many small segments and blocks of items, and one of each; ties and copies throughout."""
    monkeypatch.setattr(lexical_search, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "SPAN", 16)
    monkeypatch.setattr(lexical_search, "SHORT_SHARE", 6)
    pick = random.Random(postings)
    vocabulary = [f"t{int(n**1.5)}" for n in range(60)]

    def text(n):
        return " ".join(vocabulary[int(pick.random() ** 3 * 60)] for _ in range(n))

    docs = [(n, text(pick.randrange(1, 40))) for n in range(400)]
    docs += [(1000 + n, docs[7][1]) for n in range(60)]
    items = [(n, text(pick.randrange(1, 12))) for n in range(25)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert searched(spark, frame, items, 5) == brute(docs, items, 5)


def test_copies_beyond_k_come_by_id(spark):
    docs = [(n * 37 % 500, "the same words") for n in range(500)] + [(600, "other things")]
    got = searched(spark, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), [(1, "same words")], 7)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(7))


def test_counts_in_pieces():
    text = "Straße ÉÀ a-b_c 12x " * 300 + "x" * 5000
    for step in (1, 7, 1000):
        found = count_terms(text, step)
        assert {t.decode(): n for t, n in found.items()} == Counter(terms(text))


def test_long_lists_are_skipped():
    """With a rare term found early, most documents of the frequent ones are never scored."""
    n = 20_000
    spans = -(-n // lexical_search.SPAN)
    rng = np.random.default_rng(3)
    common = [List(np.sort(rng.choice(n, n // 2, replace=False)), rng.integers(1, 1000, n // 2), spans) for _ in range(3)]
    rare = List(np.arange(40), np.full(40, 1000), spans)
    lists = [(rare, 50), *((x, 3) for x in common)]
    scores = np.zeros(n, np.int64)
    for x, factor in lists:
        scores[x.places] += x.worth * factor
    best = Best(20)
    scored = rank_segment(lists, list(range(n)), best)
    want = sorted((-s, False, i) for i, s in enumerate(scores.tolist()) if s > 0)[:20]
    assert best.rows == want
    assert scored < n // 10
