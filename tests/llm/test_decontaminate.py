from __future__ import annotations

import itertools
import random

import brute
import odd
import pytest

from orderlens.llm import decontaminate
from orderlens.llm.common import table

ITEMS = [
    (1, " ".join(f"passage{n}" for n in range(60))),
    (2, None),
    (3, ""),
    (4, "too few words"),
    (5, "just eight words are enough for an item"),
    (5, "just eight words are enough for an item"),
    (None, "an item without any id that has enough words to be found here"),
]


def items(spark, rows=ITEMS):
    clash = [f"{c} string" for c in ("doc", "item", "seed", "span", "at", "doc_at", "item_at", "key_a")]
    schema = "item_id bigint, text string, " + ", ".join(clash)
    return spark.createDataFrame([(*r, *["clash"] * len(clash)) for r in rows], schema)


def check(spark, docs, rows, bench, bench_rows, **options):
    want = brute.leaks([t for _, t in rows], [t for _, t in bench_rows])
    want = {(rows[d][0], bench_rows[k][0]) for d, k in want}
    got = decontaminate.leaks(docs, bench, **options).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == want
    left = decontaminate.drop_leaks(docs, bench, **options)
    assert left.columns == docs.columns
    gone = {rows[d] for d, _ in brute.leaks([t for _, t in rows], [t for _, t in bench_rows])}
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted((r for r in rows if r not in gone), key=repr)
    return want


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_table(spark, folder, limit):
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(spark, docs, rows, bench, [tuple(r) for r in bench.select("item_id", "text").collect()], broadcast_words=limit)


def texts():
    pick = random.Random(6)
    passage = ITEMS[0][1].split()
    out = [(r[0], r[1]) for r in odd.DOC_ROWS]
    for n in range(40):
        words = passage[(start := pick.randrange(30)) : start + pick.randrange(12, 30)]
        for _ in range(n % 8):
            words[pick.randrange(len(words))] = "other"
        out.append((100 + n, "Some, words; " + " ".join(words).title() + " -- and more!"))
    out.append((200, "Just: eight WORDS are enough (for) an item"))
    out.append((201, "We said just eight words are enough for one item"))
    out.append((202, "see an item without any id, that has MORE words to be found here."))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_odd_rows_and_replaced_words(spark, limit):
    rows = texts()
    docs = odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows])
    found = check(spark, docs, rows, items(spark), ITEMS, broadcast_words=limit)
    assert {(200, 5), (201, 5), (202, None), (6, 1), (7, 1)} <= found
    assert 10 < sum(100 <= (d or 0) < 140 for d, _ in found) < 40


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_no_rows(spark, limit):
    docs = odd.documents(spark)
    assert decontaminate.leaks(docs, items(spark, []), broadcast_words=limit).collect() == []
    assert decontaminate.drop_leaks(docs, items(spark, []), broadcast_words=limit).count() == len(odd.DOC_ROWS)
    assert decontaminate.leaks(odd.documents(spark, []), items(spark), broadcast_words=limit).collect() == []


def test_plan_has_no_python_and_broadcasts_the_benchmark_only(spark, folder):
    df = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoop" not in plan and "BroadcastHashJoin" in plan


def test_masks_hit_every_window_with_a_fifth_replaced():
    for width in range(10, 21):
        for replaced in itertools.combinations(range(width), width // 5):
            assert any(
                all(c == "0" or start + n not in replaced for n, c in enumerate(mask))
                for mask in decontaminate.MASKS
                for start in range(width - len(mask) + 1)
            ), (width, replaced)


def leaks_without_seeds(docs, items, window=20, percent=80, least=8):
    """(document number, item number) pairs, by laying every window over every other."""
    found = set()
    for (d, text), (k, item) in itertools.product(enumerate(docs), enumerate(items)):
        a, b = brute.leak_words(text), brute.leak_words(item)
        width = min(window, len(a), len(b))
        if width >= least and any(
            100 * sum(x == y for x, y in zip(a[p : p + width], b[q : q + width])) >= percent * width
            for p in range(len(a) - width + 1)
            for q in range(len(b) - width + 1)
        ):
            found.add((d, k))
    return found


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_same_as_without_seeds(spark, limit):
    pick = random.Random(5)
    bench = [" ".join(f"i{k}w{n}" for n in range(size)) for k, size in enumerate((8, 9, 10, 11, 12, 14, 15, 17, 19, 20, 26, 35))]
    texts = []
    for k, item in enumerate(bench):
        for turn in range(24):
            words = item.split()
            # All up to a fifth at random, some one more; or one word in every five.
            count = len(words) // 5 + (turn % 4 == 3)
            places = range(turn % 5, len(words), 5) if turn % 4 == 2 else pick.sample(range(len(words)), count)
            for n in places:
                words[n] = "other"
            texts.append(" ".join(["before"] * (turn % 3) + words + ["after"] * (turn % 2)))
    docs = odd.documents(spark, [(d, t, "en", "a", 1) for d, t in enumerate(texts)])
    found = decontaminate.leaks(docs, items(spark, list(enumerate(bench))), broadcast_words=limit)
    want = leaks_without_seeds(texts, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert 100 < len(want) < len(texts)


def test_short_masks_hit_every_window_with_one_word_replaced():
    for replaced in range(8):
        assert any(mask[replaced] == "0" for mask in decontaminate.SHORT_MASKS)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_other_items_do_not_matter(spark, limit):
    """Documents of 7 to 12 words, whole or with a word replaced, out of a long item and next to short ones."""
    long = [f"p{n}" for n in range(30)]
    rows = []
    for size in range(7, 13):
        for place in (None, *range(size)):
            words = long[5 : 5 + size]
            if place is not None:
                words[place] = "other"
            rows.append((len(rows), " ".join(words)))
    docs = odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows])
    alone = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items(spark, [(1, " ".join(long))]), broadcast_words=limit).collect()}
    assert alone == {(d, 1) for d, t in rows if len(t.split()) >= 8 and 100 * sum(w != "other" for w in t.split()) >= 80 * len(t.split())}
    more = [(1, " ".join(long)), (2, " ".join(f"x{n}" for n in range(8))), (3, "seven words are too few for it")]
    both = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items(spark, more), broadcast_words=limit).collect()}
    assert both == alone


def test_a_common_phrase_is_shuffled_without_loss(spark):
    """Half of the documents and of the items hold the same eight words; few pairs agree beyond them."""
    pick = random.Random(9)
    phrase = "this is what every one of them says"
    bench = [(k, " ".join([f"i{k}w{n}" for n in range(9)] + ([phrase] if k % 2 else []) + [f"i{k}e{n}" for n in range(9)])) for k in range(40)]
    docs = []
    for d in range(400):
        own = [f"d{d}w{n}" for n in range(pick.randrange(8, 20))]
        kind = [phrase] if d % 2 else []
        leak = bench[pick.randrange(40)][1].split()[: pick.randrange(10, 27)] if d % 10 == 0 else []
        docs.append((d, " ".join([*own, *kind, *leak, *own[:3]])))
    frame = odd.documents(spark, [(d, t, "en", "a", 1) for d, t in docs])
    found = [{(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, items(spark, bench), broadcast_words=n).collect()} for n in (0, 50_000)]
    want = {(docs[d][0], bench[k][0]) for d, k in brute.leaks([t for _, t in docs], [t for _, t in bench])}
    assert found == [want, want] and 10 <= len(want) < 200
