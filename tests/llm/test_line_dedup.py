from __future__ import annotations

import random

import brute
import odd

from orderlens.llm import line_dedup
from orderlens.llm.common import table


def check(spark, docs, rows):
    """``rows``: (doc_id, text) without repeated rows, though ``docs`` may repeat them."""
    want = dict(zip(rows, brute.line_dedup(rows)))
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "row.text", "kept", "n_lines", "n_removed").collect()
    for r in got:
        kept = want[r.doc_id, r.text]
        assert r.kept == kept
        lines = 0 if r.text is None else len(r.text.split("\n"))
        assert r.n_lines == lines
        if kept == r.text:
            assert r.n_removed == 0 or not kept
        elif kept:
            assert r.n_removed == lines - len(kept.split("\n"))
        else:
            assert r.n_removed == lines
    return got


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert any(r.n_removed for r in check(spark, docs, rows))


def ordered_ties(rows):
    """Rows in the order in which operators take them: ties in doc_id by the hash that decides."""
    return list(dict.fromkeys(rows))


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = check(spark, docs, ordered_ties([(r[0], r[1]) for r in odd.DOC_ROWS]))
    assert len(got) == len(odd.DOC_ROWS)
    assert {r.kept for r in got if r.doc_id == 3} == {odd.DOC_ROWS[2][1]}
    assert [r.n_removed for r in got if r.doc_id == 4 and r.text.startswith("one")][0] > 0
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert line_dedup.drop_repeated_lines(odd.documents(spark, [])).collect() == []


def test_shifted_passages(spark):
    pick = random.Random(8)
    passage = [f"line {n} of the passage {pick.random()}" for n in range(30)]
    rows = []
    for n in range(40):
        before = [f"own line {pick.random()}" for _ in range(pick.randrange(6))]
        after = [f"own end {pick.random()}" for _ in range(pick.randrange(6))]
        rows.append((n, "\n".join([*before, *passage[pick.randrange(4) :], *after])))
    got = check(spark, odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows]), rows)
    assert sum(r.n_removed for r in got if r.doc_id > 5) > 34 * 15


def test_single_lines_and_blank_lines_stay(spark):
    rows = [(n, f"own {n}\n\n\nshared line\n\n\nown end {n}") for n in range(10)] + [(20, "only"), (21, "only"), (22, "\n\n"), (23, "\n\n")]
    got = check(spark, odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows]), rows)
    assert all(r.n_removed == 0 for r in got)


def test_dropped_documents_had_only_repeats(spark):
    text = "\n".join(f"a line with number {n}" for n in range(12))
    rows = [(1, text), (2, text), (3, ""), (4, None), (5, text + "\nand one more line\nand another")]
    left = line_dedup.drop_repeated_lines(odd.documents(spark, [(d, t, "en", "a", 7) for d, t in rows]))
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    brutal = dict(zip((d for d, _ in rows), brute.line_dedup(rows)))
    assert set(got) == {d for d, t in rows if not t or brute.WORD.search(brutal[d] or "")}
    for d, (kept, chars) in got.items():
        assert kept == brutal[d] and chars == (7 if kept == dict(rows)[d] else len(kept))


def test_plan_has_no_python(spark, folder):
    plan = line_dedup.dedup_lines(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def lines_left(rows):
    """What stays of each text: a line goes if two neighbouring worded lines, it among them, stood at an earlier place."""
    seen, out = set(), []
    for _, text in sorted(rows):
        lines = text.split("\n")
        worded = [n for n, line in enumerate(lines) if brute.WORD.search(line)]
        gone = set()
        for a, b in zip(worded, worded[1:]):
            body = tuple(lines[a : b + 1])
            if body in seen:
                gone |= set(range(a, b + 1))
            seen.add(body)
        out.append([line for n, line in enumerate(lines) if n not in gone])
    return out


def test_whole_passages_of_any_length_go(spark):
    """Two documents a length share a passage between own lines; all of it goes from the second."""
    rows, passages = [], {}
    for length in (2, 3, 4, 5, 8, 12, 20, 40):
        for turn in range(5):
            passage = [f"shared {length} {turn} {n}" + "\n" * (n % 3) for n in range(length)]
            for copy in range(2):
                d = len(rows)
                rows.append((d, "\n".join([f"own {d} a", "", f"own {d} b", *passage, f"own {d} c", f"own {d} d"])))
            passages[d] = len("\n".join(passage).rstrip("\n").split("\n"))
    found = line_dedup.dedup_lines(odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows]), whole=True)
    got = {r.doc_id: r for r in found.select("row.doc_id", "kept", "n_removed").collect()}
    for (d, text), left in zip(rows, lines_left(rows)):
        assert got[d].kept == "\n".join(left)
        assert got[d].n_removed == passages.get(d, 0)
        assert "shared" not in got[d].kept or d not in passages


def test_whole_copies_vanish_or_stay_as_they_are(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, whole=True).collect()}
    first, later = {}, 0
    for d, text in sorted(rows):
        if first.setdefault(text, d) != d:
            later += 1
            assert left.get(d) in (None, text)
    assert later
    for (d, text), lines in zip(sorted(rows), lines_left(rows)):
        body = "\n".join(lines)
        assert left.get(d) == (body if body == text or brute.WORD.search(body) else None)


def test_whole_takes_odd_rows_and_needs_no_python(spark):
    found = line_dedup.dedup_lines(odd.documents(spark), whole=True)
    rows = found.select("row.doc_id", "row.text", "kept", "n_lines", "n_removed").collect()
    assert len(rows) == len(odd.DOC_ROWS)
    for r in rows:
        if r.doc_id == 11:
            assert r.kept == "same line again" and r.n_removed == 11
        elif r.doc_id == 4 and r.text.startswith("one"):
            assert r.kept == "" and r.n_removed == 6
        else:
            assert r.kept == r.text and r.n_removed == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan
    assert line_dedup.drop_repeated_lines(odd.documents(spark, []), whole=True).collect() == []


def test_share_of_passages_that_chunks_remove(spark):
    """Against lines judged without chunks: nothing else goes, long passages go for the most part, copies wholly."""
    pick, rows, lengths = random.Random(3), [], {}
    for length in (2, 5, 12, 20, 40):
        for turn in range(30):
            passage = [f"shared {length} {turn} {n}" for n in range(length)]
            for _ in range(2):
                d = len(rows)
                before = [f"own {d} {n}" for n in range(pick.randrange(1, 6))]
                rows.append((d, "\n".join([*before, *passage, *(f"end {d} {n}" for n in range(pick.randrange(1, 6)))])))
            lengths[d] = length
    copies = [(1000 + n, rows[n][1]) for n in range(0, len(rows), 7)]
    found = line_dedup.dedup_lines(odd.documents(spark, [(d, t, "en", "a", 1) for d, t in rows + copies]))
    got = {r.doc_id: r for r in found.select("row.doc_id", "kept", "n_removed").collect()}
    removed = dict.fromkeys(lengths.values(), 0)
    for (d, text), left in zip(rows, lines_left(rows)):
        assert set(left) <= set(got[d].kept.split("\n"))
        if d in lengths:
            removed[lengths[d]] += got[d].n_removed
    shares = {length: n / (30 * length) for length, n in removed.items()}
    assert shares[12] > 0.3 and shares[20] > 0.55 and shares[40] > 0.75
    assert all(got[d].kept == "" for d, _ in copies)
