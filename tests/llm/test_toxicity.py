from __future__ import annotations

import random
import zlib

import numpy as np
import odd
import pytest

from orderlens.llm import toxicity
from orderlens.llm.common import table


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.mark.parametrize("n", [0, 1, 35, 36, 47, 48, 49, 84, 85, 1000])
def test_windows_cover_texts_and_overlap(n):
    begin, size, first = toxicity.windows([n, 3])
    own = [(b, s) for b, s in zip(begin.tolist(), size.tolist())][: first[1]]
    assert {p for b, s in own for p in range(b, b + s)} == set(range(n))
    assert all(s == toxicity.WINDOW for _, s in own[:-1])
    assert all(b + s > c for (b, s), (c, _) in zip(own, own[1:]))
    assert (begin[first[1] :].tolist(), size[first[1] :].tolist()) == ([n], [3])


def test_gradients_match_differences():
    net, words = toxicity.Network(1), toxicity.Words()
    for name in net.w:
        net.w[name] = net.w[name].astype(np.float64)
    ids = words.number("the quick idiot jumps over lazy dogs the end".split()).astype(np.int64)
    words.own, words.grams, words.sizes = words.settle()
    grid = np.full((3, 6), -1)
    grid[0], grid[1, :4], grid[2, :1] = ids[:6], ids[5:], ids[2]
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    def loss():
        gates = net.gates(net.inputs(words.own, words.grams, words.sizes))
        x = net.logits(gates, np.where(grid < 0, len(words.own), grid))
        return float((weights * (np.log1p(np.exp(x)) - labels * x)).sum())

    slopes = net.gradients(words, grid, labels, weights)
    assert set(slopes) == set(net.w)
    rng = np.random.default_rng(0)
    for name, slope in slopes.items():
        flat = net.w[name].reshape(-1)
        moved = np.flatnonzero(np.abs(slope.reshape(-1)) > 1e-3)
        for k in rng.choice(moved, size=min(4, len(moved)), replace=False):
            was = flat[k]
            flat[k] = was + 1e-2
            up = loss()
            flat[k] = was - 1e-2
            down = loss()
            flat[k] = was
            assert (up - down) / 2e-2 == pytest.approx(slope.reshape(-1)[k], rel=0.05, abs=2e-3), name


def sentences(n, seed, bad=("grolk", "vrasht", "zumpf")):
    pick, rows = random.Random(seed), []
    common = [f"{a}{b}" for a in ("ta", "lo", "mi", "ne") for b in ("ra", "sol", "ti", "ka", "min")]
    for k in range(n):
        words = [pick.choice(common) for _ in range(pick.randrange(20, 200))]
        toxic = int(k % 3 == 0)
        for _ in range(3 * toxic):
            words[pick.randrange(len(words))] = pick.choice(bad)
        rows.append((" ".join(words).capitalize() + ".", toxic))
    return rows


def test_held_out_accuracy_by_words_and_by_characters():
    net = toxicity.train(*map(list, zip(*sentences(300, 1))))
    scorer = toxicity.Scorer(net)
    rows = sentences(150, 2)
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(scorer([t for t, _ in rows]), rows)]) > 0.95
    # Endings never seen in training: only the characters tell.
    rows = sentences(150, 3, ("grolky", "vrashty", "zumpfen"))
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(scorer([t for t, _ in rows]), rows)]) > 0.85


def test_remembered_words_do_not_change_scores(monkeypatch):
    net = toxicity.train(*map(list, zip(*sentences(60, 4))), epochs=1)
    texts = [t for t, _ in sentences(30, 5)] + ["", None, "one " * 500]
    whole = toxicity.Scorer(net)(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    monkeypatch.setattr(toxicity, "AT_A_TIME", 7)
    scorer = toxicity.Scorer(net)
    assert [scorer([t])[0] for t in texts] == pytest.approx(whole, abs=1e-5)


@pytest.mark.parametrize("labels, high", [([], False), ([0, 0], False), ([1, 1], True)])
def test_without_both_labels(labels, high):
    scores = toxicity.Scorer(toxicity.train(["some text"] * len(labels), labels))(["any", "", None])
    assert all((s >= 0.5) == high and 0 <= s <= 1 for s in scores)


def labels_of(spark, rows):
    return spark.createDataFrame([(d, 1, t, "clash") for d, t in rows], "doc_id bigint, quality int, toxic int, text string")


def test_odd_rows(spark):
    labels = labels_of(spark, [(3, 0), (3, 1), (4, 0), (6, 1), (7, None), (None, 1), (99, 1), (10, 0)])
    texts, toxic = toxicity.training_texts(odd.documents(spark), labels)
    known = {3: 1, 4: 0, 6: 1, 10: 0}
    assert sorted(toxic) == sorted(y for d, y in known.items() if not held_out(d))
    rows = toxicity.judge(odd.documents(spark), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd.DOC_ROWS)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(r.doc_id)
    assert toxicity.judge(odd.documents(spark, []), labels).collect() == []
    assert toxicity.judge(odd.documents(spark), labels_of(spark, [])).count() == len(odd.DOC_ROWS)


def test_training_rows_are_bounded_and_not_held_out(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    texts, toxic = toxicity.training_texts(docs, labels, 5)
    assert toxic.count(0) <= 5 and toxic.count(1) <= 5
    out = {r.text for r in docs.collect() if held_out(r.doc_id)}
    other = {r.text for r in docs.collect() if not held_out(r.doc_id)}
    assert set(toxicity.training_texts(docs, labels)[0]) <= other | (out & other)


def test_table_at_hundredth_scale_is_mostly_right(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    assert len(rows) == table(spark, folder, "documents").count()
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) > 0.85
