from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import odd
import pytest

from orderlens.llm import filter_audit
from orderlens.llm.filter_audit import WordTable, count_texts
from orderlens.llm.words import Block

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = [(1, 1, 0), (3, 1, 0), (3, 0, 1), (4, 0, 0), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


def counts(text: str) -> list[int]:
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def brute(rows: list[tuple], labels: list[tuple]) -> dict:
    """(part, order, step) to the seven counts, order by order."""
    texts = [t or "" for _, t, _ in rows]
    fails = []
    for (doc_id, _, _), text in zip(rows, texts):
        words, distinct, capitals, points, symbols = counts(text)
        copy = doc_id is not None and any(t == text and d is not None and d < doc_id for (d, _, _), t in zip(rows, texts))
        failing = zip("ABCDE", (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, copy))
        fails.append({name for name, bad in failing if bad})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out: dict = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(rows[i][0], fails[i]) for i in range(len(rows)) if (rows[i][2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[name] += len(gone)
                failing = [x for x in own if name in x[1]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    sum(x[1] == {name} for x in own),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                ]
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[name])
    return out


def audited(spark, docs, labels) -> dict:
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in filter_audit.audit(docs, marks).collect()}


def test_odd_rows(spark):
    rows = [(r[0], r[1], r[2]) for r in odd.DOC_ROWS]
    got = audited(spark, odd.documents(spark), LABELS)
    assert got == brute(rows, LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_no_rows(spark):
    assert audited(spark, odd.documents(spark, []), LABELS) == {}
    assert audited(spark, odd.documents(spark, odd.DOC_ROWS[:3]), [])


def test_copies_of_one_text(spark):
    """A text that most rows have, under ids that repeat and are missing."""
    rows = [(n % 7 if n % 5 else None, "A copied text #1", "en") for n in range(60)] + [(n, f"own text {n}", None) for n in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    assert audited(spark, docs, LABELS) == brute(rows, LABELS)


@pytest.mark.parametrize("step", [1, 3, 17, 1 << 20])
def test_counts_of_random_texts(step):
    pick = random.Random(step)
    letters = "aB \t\n#é한\U0001f600|$Z\x0b\x85 "
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(200)]
    found = count_texts([t.encode() for t in texts], step)
    assert found.tolist() == [counts(t) for t in texts]


def test_long_text_and_long_words():
    pick = random.Random(5)
    words = ["x" * 400, "x" * 399 + "y", "x" * 300, "y" * 9, "y" * 8, "é" * 200] + [f"w{n}" for n in range(50)]
    text = " ".join(pick.choice(words) for _ in range(5000))
    for step in (100, 1000, 1 << 20):
        assert count_texts([text.encode()], step).tolist() == [counts(text)]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(Block, "hashes", lambda self, starts, lengths: np.zeros(len(starts), np.uint64))
    words = [f"word{n % 40}" for n in range(300)] + ["longer than eight bytes"[: 9 + n % 5].replace(" ", "_") for n in range(50)]
    block = Block(" ".join(words).encode())
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    table = WordTable(block)
    new = len(table.insert(np.zeros(200, np.int64), starts[:200], lengths[:200])) + len(table.insert(np.zeros(150, np.int64), starts[200:], lengths[200:]))
    assert new == len(set(words))
