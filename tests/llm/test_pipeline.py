"""Every stage of the pipeline on its own input, against brute force."""

from __future__ import annotations

import brute
import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderlens.llm import mixing
from orderlens.llm.common import DOCUMENT_COLUMNS, table


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def drop_copies(rows):
    kept = []
    for members in {frozenset(c) for c in brute.near_classes([brute.fingerprint(t) for _, t in rows])}:
        kept.append(rows[min(members, key=lambda i: rows[i][0])])
    return kept


def drop_lines(rows):
    return [
        (d, new) for (d, old), new in zip(rows, brute.line_dedup(rows)) if new == old or brute.WORD.search(new)
    ]


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """What each stage returned, written and read again, in order."""
    docs, out = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, folder).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages(outputs, spark, folder):
    bench = [t for (t,) in table(spark, folder, "benchmark").select("text").collect()]

    def drop_leaks(rows):
        found = {d for d, _ in brute.leaks([t for _, t in rows], bench)}
        return [r for n, r in enumerate(rows) if n not in found]

    plain = [lambda rows: [r for r in rows if brute.good(r[1])], drop_lines, drop_copies, drop_leaks]
    for (before, after), expected in zip(outputs, plain):
        assert tuple(after.columns) == DOCUMENT_COLUMNS
        assert sorted(rows_of(after)) == sorted(expected(rows_of(before)))
        assert after.count() < before.count() or expected in (drop_lines, drop_copies)
        assert after.filter(F.length("text") != F.col("n_chars")).count() == before.filter(F.length("text") != F.col("n_chars")).count()


def test_last_stage_mixes(outputs):
    before, after = outputs[-1]
    sized = before.withColumn("size", mixing.word_count(F.col("text")))
    want = {r.doc_id: r.copies for r in mixing.mix(sized).collect() if r.copies}
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append(r["copy"])
    assert {d: sorted(c) for d, c in got.items()} == {d: list(range(1, n + 1)) for d, n in want.items()}


def test_run_gives_the_last_stage(outputs, spark, folder):
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, outputs[-1][1].collect()))


def test_run_leaves_the_last_result_only(spark, folder):
    """Within a scope, so that nothing of other tests is in the folder."""
    import glob

    from orderlens.session import fresh_path, scope

    with scope(spark):
        base = fresh_path(spark, "x").rpartition("/")[0]
        found = corpus_pipeline.run(spark, folder)
        assert [p.rpartition("/")[2].partition("-")[0] for p in glob.glob(f"{base}/*")] == ["source_mixing"]
        assert found.count() > 0
    assert glob.glob(f"{base}/*") == []


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_odd_and_no_rows(spark, folder, rows):
    for _, stage in corpus_pipeline.STAGES:
        docs = odd.documents(spark, rows).drop("copy")
        assert stage(spark, docs, folder).drop("copy").columns == docs.columns
        assert stage(spark, docs, folder).count() <= 2 * len(odd.DOC_ROWS if rows is None else rows)


def test_stages_are_those_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("whole", [False, True])
def test_line_dedup_leaves_no_scraps_of_copies(outputs, spark, folder, whole):
    """Later copies go, or stay as they are for the next stage, which takes them."""
    docs = outputs[1][0]
    texts, first = dict(rows_of(docs)), {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    copies = {d for d, text in texts.items() if first[text] != d}
    stage = corpus_pipeline.whole_line_dedup if whole else corpus_pipeline.line_dedup_stage
    left = dict(rows_of(stage(spark, docs, folder)))
    assert copies and all(left[d] == texts[d] for d in copies if d in left)
    assert not copies & {r.doc_id for r in corpus_pipeline.run(spark, folder, whole=whole).collect()}
