from __future__ import annotations

import hashlib
import random
import re

import odd
import pytest
from pyspark.sql import functions as F

from orderlens.llm import substring_dedup
from orderlens.llm.common import table
from orderlens.llm.substring_dedup import Reference, drop_repeats, measure_repeats, parse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = float("inf")


def brute(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256, spans), by a table of all windows."""
    least: dict = {}
    texts = [(LAST if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (doc_id, _), (d, words) in zip(rows, texts):
        gone = [False] * (len(words) + 1)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        edges = [i for i in range(len(gone)) if gone[i] != (gone[i - 1] if i else False)]
        spans = list(zip(edges[::2], edges[1::2]))
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), spans))
    return sorted(out, key=repr)


def check(spark, rows, window, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = measure_repeats(docs, window=window, **options).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, [tuple(s) for s in r.spans or []]) for r in found), key=repr)
    want = brute(rows, window)
    assert got == want
    return sum(w[2] for w in want)


def test_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    assert check(spark, rows, 13) > 0


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd.DOC_ROWS] + [(None, odd.LONG), (20, odd.LONG + " and more"), (-3, odd.PASSAGE)]
    assert check(spark, rows, 13) > 0
    assert measure_repeats(odd.documents(spark)).count() == len(odd.DOC_ROWS)


def test_no_rows(spark):
    assert measure_repeats(odd.documents(spark, [])).collect() == []


@pytest.mark.parametrize("letters, window, run", [(2, 8, 3), (3, 6, 2), (4, 5, 5), (3, 4, 1)])
def test_random_texts(spark, letters, window, run):
    pick = random.Random(window)
    rows = [(pick.randrange(50), " ".join(pick.choice("abcdef"[:letters]) for _ in range(pick.randrange(80)))) for _ in range(70)]
    assert check(spark, rows, window, run=run) > 0


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_crowded_blocks_are_cut_by_windows(spark, most):
    """A short run in many texts, whose surroundings some share."""
    pick = random.Random(most)
    middle = " ".join(pick.choice("abcdef") for _ in range(6))
    sides = [" ".join(pick.choice("abcdef") for _ in range(9)) for _ in range(5)]
    rows = [(n, f"{pick.choice(sides)} {middle} {pick.choice(sides)} x{n} {pick.choice(sides)}") for n in range(90)]
    assert check(spark, rows, 13, block_pieces=most) > 0


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 20)
    pick = random.Random(2)
    words = [f"w{pick.randrange(40)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[37:311]) + " end"), (3, "\n".join(words[:200] + words[:200]))]
    assert check(spark, rows, 13) > 600


def test_within_a_document_and_between_equal_ids(spark):
    passage = " ".join(f"p{n}" for n in range(20))
    rows = [(5, f"{passage} a {passage}"), (5, f"b {passage}"), (6, f"{passage}\tc"), (None, f"d {passage}"), (None, f"e {passage}")]
    assert check(spark, rows, 13) == 20 * 3


def test_factors_are_the_longest_and_go_on_within_their_ends():
    reference = Reference(3)
    reference.add(tuple("abcde"))
    reference.add(tuple("defgh"))
    assert reference.longest(tuple("bcdex")) == 4
    assert reference.longest(tuple("xbcde")) == 0
    # "cde" ends the first factor, "def" straddles it and starts the second one.
    assert parse(tuple("xabcdefgx"), reference) == [(1, 8)]
    assert parse(tuple("abcxdefxab"), reference) == [(0, 3), (4, 7)]
    # Factors that only touch cover what two windows cover.
    assert parse(tuple("abcefg"), reference) == [(0, 6)]


def test_rows_keep_their_columns(spark):
    docs = odd.documents(spark, [*odd.DOC_ROWS, (7, f"{odd.PASSAGE}  and   two", None, None, 3)])
    cleaned = drop_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    texts = {r.text for r in cleaned.filter(F.col("doc_id") == 7).collect()}
    assert texts == {"some other start and its own end", "and two"}
    assert cleaned.filter("doc_id = 6").first().text == odd.DOC_ROWS[9][1]
