from __future__ import annotations

import random

import brute
import numpy as np
import odd
import pytest

from orderlens.llm import simhash
from orderlens.llm.common import table


def expected(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    out = []
    for print_, members in zip(prints, brute.near_classes(prints)):
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out.append((f"{print_:016x}", min(ids) if ids else None))
    return out


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {d: e for (d, _), e in zip(rows, expected(rows))}
    assert any(c != d for d, (_, c) in found.items())


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd.DOC_ROWS]
    found = simhash.near_duplicates(odd.documents(spark)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == sorted(
        ((d, *e) for (d, _), e in zip(rows, expected(rows))), key=repr
    )


def test_no_rows(spark):
    empty = odd.documents(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_one_row_of_each_class_stays(spark):
    docs = odd.documents(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r[0], r[1]) for r in odd.DOC_ROWS]
    classes = brute.near_classes([brute.fingerprint(t) for _, t in rows])
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len({frozenset(c) for c in classes})
    for members in classes:
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        own = [x for x in left if x in [rows[i] for i in members]]
        assert len(own) == 1 and own[0][0] == (min(ids) if ids else None)


def clustered(n, seed, spread=6):
    pick = random.Random(seed)
    centres = [pick.getrandbits(64) for _ in range(n // 20)] + [0]
    out = set()
    while len(out) < n:
        x = pick.choice(centres) if pick.random() < 0.6 else pick.getrandbits(64)
        for _ in range(pick.randrange(spread)):
            x ^= 1 << pick.randrange(64)
        out.add(x)
    return np.array(sorted(out, key=lambda v: pick.random()), dtype=np.uint64)


def pairs_of(values, bits):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    i, j = np.nonzero(np.triu(near, 1))
    return {frozenset((int(a), int(b))) for a, b in zip(values[i], values[j])}


@pytest.mark.parametrize("bits", [0, 1, 2, 5])
def test_near_pairs_are_exact(bits):
    values = clustered(3000, bits)
    got = [frozenset((int(a), int(b))) for x, y in simhash.near_pairs(values, None, bits) for a, b in zip(x, y)]
    assert len(got) == len(set(got))
    assert set(got) == pairs_of(values, bits)


@pytest.mark.parametrize("bits", [2, 4])
def test_leaves_meet_every_pair_once(spark, bits):
    values = clustered(2500, 50 + bits)
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint").repartition(3)
    rows = simhash.links(points, bits, every=True, leaf=100).collect()
    got = [frozenset((r.a % 2**64, r.b % 2**64)) for r in rows]
    assert len(got) == len(set(got)) and set(got) == pairs_of(values, bits)
    forest = simhash.links(points, bits, leaf=100).collect()
    assert {frozenset((r.a % 2**64, r.b % 2**64)) for r in forest} <= set(got)
    links = [(r.a, r.b) for r in rows], [(r.a, r.b) for r in forest]
    assert roots(links[0]) == roots(links[1])


def roots(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, left = {}, set(near)
    while left:
        todo, found = [left.pop()], set()
        while todo:
            x = todo.pop()
            found.add(x)
            todo += near[x] & left
            left -= near[x]
        out |= {x: min(found) for x in found}
    return out


def test_components_of_chains_stars_and_repeated_edges(spark):
    pick = random.Random(4)
    edges = [(n, n + 1) for n in range(100)] + [(500, n) for n in range(501, 560)] + [(-7, 3), (3, -7), (900, 901), (9, 9)]
    pick.shuffle(edges)
    got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got if r.node != r.root} == {x: r for x, r in roots([e for e in edges if e[0] != e[1]]).items() if x != r}


def test_fingerprint_counts_repeated_shingles_and_long_texts():
    for text in ("a b c a b c a b c x", "A  b\tC", "one", "one two", " ".join(f"w{n}" for n in range(70_000))):
        assert simhash.fingerprint(text) == brute.fingerprint(text)
