"""SimHash near-duplicates by vantage-point trees over fingerprints.

A text's fingerprint has 64 bits; bit i is 1 if over half of its shingle
hashes have bit i set. Two fingerprints link if they differ in at most
``max_bits`` bits, and the classes of linked texts are connected components.

The distinct fingerprints are cut by a vantage-point tree. A node holds a
vantage fingerprint and a radius; its points are those inside and those
outside the ball. By the triangle inequality two points on different sides
can only link if one lies within ``max_bits`` below the radius and the other
within ``max_bits`` above it, so a third branch holds just these two rims, to
be compared with each other and not within themselves. Every linked pair thus
meets in exactly one leaf, and nearly all others are pruned. A leaf is cut
further, by the same rule, in the task that holds it.

The tree's cuts are placed on a bounded sample of fingerprints (``SAMPLE``);
the sample drops no row, it only decides how evenly leaves are filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import map_rows, text_key
from orderlens.session import store

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# Shingle hashes are counted in blocks of this many.
HASHES_AT_A_TIME = 65_536
# At most so many fingerprints place the cuts; a leaf holds about LEAF of the table's.
SAMPLE = 65_536
LEAF = 4096
# In a task, problems are cut until one side has at most this many points.
SMALL = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: len(words) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = len(starts)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, total, HASHES_AT_A_TIME):
        spans = zip(starts[at : at + HASHES_AT_A_TIME].tolist(), ends[at : at + HASHES_AT_A_TIME].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[2 * counts > total]).sum(dtype=np.uint64))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``, the 64 bits as a signed long, of every row."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            yield {**{c: row[c] for c in keep}, "fp": _signed(fingerprint(row["text"], shingle_words))}

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep)
    return map_rows(docs.select(*keep, "text"), work, f"{schema}, fp bigint")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- the tree

Node = tuple  # (vantage, radius, {branch: Node}) or () for a leaf


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _cut(points: np.ndarray, choice: int) -> tuple[np.uint64, int]:
    """A vantage point and the radius that halves the points around it."""
    vantage = points[choice % len(points)]
    return vantage, int(np.median(_distance(points, vantage)))


def _parts(left: np.ndarray, right: np.ndarray | None, cut: tuple, bits: int) -> dict[str, tuple]:
    """Masks over the two sides of a problem for each of its branches.

    A problem with one side asks for the links within it, one with two sides
    for those between them. Branch names: ``i``/``o`` inside and outside,
    ``x`` inner rim of the left with outer rim of the right, ``y`` the reverse.
    """
    vantage, radius = cut
    dl = _distance(left, vantage)
    inside, outside = dl <= radius, dl > radius
    inner, outer = inside & (dl > radius - bits), outside & (dl <= radius + bits)
    if right is None:
        return {"i": (inside, None), "o": (outside, None), "x": (inner, outer)}
    dr = _distance(right, vantage)
    near, far = dr <= radius, dr > radius
    return {
        "i": (inside, near),
        "o": (outside, far),
        "x": (inner, far & (dr <= radius + bits)),
        "y": (outer, near & (dr > radius - bits)),
    }


def _stuck(left: np.ndarray, right: np.ndarray | None, parts: dict) -> bool:
    """Whether a branch is nearly as large as the problem itself."""
    size = len(left) + (0 if right is None else len(right))
    return any(a.sum() + (0 if b is None else b.sum()) > 0.9 * size for a, b in parts.values())


def build_tree(sample: np.ndarray, per_point: float, bits: int, leaf: int = LEAF) -> Node:
    """The tree whose leaves hold about ``leaf`` points when a sampled point stands for ``per_point``."""

    def grow(left: np.ndarray, right: np.ndarray | None, depth: int) -> Node:
        larger = left if right is None or len(left) >= len(right) else right
        if depth > 40 or len(larger) < 8 or len(larger) * per_point <= leaf:
            return ()
        cut = _cut(larger, depth * 7919)
        parts, branches = _parts(left, right, cut, bits), {}
        if _stuck(left, right, parts):
            return ()
        for name, (a, b) in parts.items():
            if right is None and name != "x":
                branches[name] = grow(left[a], None, depth + 1)
            else:
                branches[name] = grow(left[a], (left if right is None else right)[b], depth + 1)
        return (*cut, branches)

    return grow(sample, None, 0)


def _route(tree: Node, points: np.ndarray, bits: int) -> Iterator[tuple[str, bool, np.ndarray]]:
    """(leaf path, on the right side, points) for all leaves that points reach."""

    def walk(node: Node, path: str, left: np.ndarray, right: np.ndarray | None) -> Iterator:
        if not len(left) and (right is None or not len(right)):
            return
        if not node:
            yield path, False, left
            if right is not None:
                yield path, True, right
            return
        vantage, radius, branches = node
        for name, (a, b) in _parts(left, right, (vantage, radius), bits).items():
            if name in branches:
                other = None if b is None else (left if right is None else right)[b]
                yield from walk(branches[name], path + name, left[a], other)

    yield from walk(tree, "", points, None)


def near_pairs(left: np.ndarray, right: np.ndarray | None, bits: int, depth: int = 0) -> Iterator[tuple]:
    """Blocks of (a, b) arrays with all pairs of at most ``bits`` different bits, each pair once."""
    smaller = len(left) if right is None else min(len(left), len(right))
    if not smaller or (right is None and smaller < 2):
        return
    larger = left if right is None or len(left) >= len(right) else right
    for attempt in range(4 if smaller > SMALL and depth < 60 else 0):
        parts = _parts(left, right, _cut(larger, depth * 7919 + attempt * 104_729), bits)
        if not _stuck(left, right, parts):
            for a, b in parts.values():
                other = None if b is None else (left if right is None else right)[b]
                yield from near_pairs(left[a], other, bits, depth + 1)
            return
    yield from _compare(left, right, bits)


def _compare(left: np.ndarray, right: np.ndarray | None, bits: int) -> Iterator[tuple]:
    others = left if right is None else right
    step = max(1, 500_000 // len(others))
    for at in range(0, len(left), step):
        block = left[at : at + step]
        start = at + 1 if right is None else 0
        rest = others[start:]
        if not len(rest):
            continue
        near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= bits
        i, j = np.nonzero(near)
        if right is None:
            later = j >= i  # rest starts one after the block's first row
            i, j = i[later], j[later]
        if len(i):
            yield block[i], rest[j]


class _Forest:
    """Union-find over fingerprints that says which links joined two classes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _leaf_links(batches: Iterator[pa.RecordBatch], bits: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Links of each leaf from rows sorted by leaf: all pairs, or just a spanning forest of them."""

    def solve(left: list, right: list) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(left) if left else np.empty(0, dtype=np.uint64)
        b = np.concatenate(right) if right else None
        forest = _Forest()
        for x, y in near_pairs(a, b, bits):
            x, y = x.view(np.int64), y.view(np.int64)
            if not every:
                kept = [n for n, (p, q) in enumerate(zip(x.tolist(), y.tolist())) if forest.join(p, q)]
                x, y = x[kept], y[kept]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    path, left, right = None, [], []
    for batch in batches:
        paths = batch.column(0).to_pylist()
        sides = np.array(batch.column(1).to_pylist(), dtype=bool)
        points = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        edges = [0, *(n for n in range(1, len(paths)) if paths[n] != paths[n - 1]), len(paths)]
        for start, end in zip(edges, edges[1:]):
            if paths[start] != path:
                if path is not None and (left or right):
                    yield from _solved(solve, path, left, right)
                path, left, right = paths[start], [], []
            side, part = sides[start:end], points[start:end]
            if len(part[~side]):
                left.append(part[~side])
            if len(part[side]):
                right.append(part[side])
    if path is not None:
        yield from _solved(solve, path, left, right)


def _solved(solve, path: str, left: list, right: list) -> Iterator[pa.RecordBatch]:
    """A path with a rim branch in it is a problem of two sides, which has no links if one is empty."""
    if ("x" in path) and not (left and right):
        return
    yield from solve(left, right)


def links(points: DataFrame, max_bits: int = MAX_BITS, every: bool = False, leaf: int = LEAF) -> DataFrame:
    """(a, b): fingerprints of ``points.fp`` (distinct, not null) with at most ``max_bits`` different bits.

    With ``every`` each such pair appears exactly once. Otherwise only a
    spanning forest of each leaf's pairs is given, which keeps every class
    whole while a dense group costs as many rows as it has points.
    """
    spark = points.sparkSession
    total = points.count()
    rows = points.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").toArrow()
    sample = rows.column("fp").to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, total / max(1, len(sample)), max_bits, leaf))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for path, right, part in _route(tree.value, values, max_bits):
                if len(part):
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array([right] * n), pa.array(part.view(np.int64))],
                        ["path", "right", "fp"],
                    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _leaf_links(batches, max_bits, every)

    routed = points.select("fp").mapInArrow(spread, "path string, right boolean, fp bigint")
    return routed.repartition("path").sortWithinPartitions("path").mapInArrow(pairs, "a bigint, b bigint")


# ---------------------------------------------------------------- classes


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each class, by alternating large and small stars.

    ``edges`` has long columns ``a`` and ``b``. Every round is written to the
    shared folder; rounds end when the edges no longer change.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38, 0)))")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, group, component_id) of stored rows with ``doc_id`` and ``fp``."""
    points = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = components(links(points.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    known = points.join(roots, "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    named = known.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return known.select("fp", "group").join(named, "group")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint, group, component_id.

    ``group`` names the class (its smallest fingerprint as a signed number) and
    ``component_id`` is its smallest doc_id. Texts that are null, empty or
    without words have fingerprint 0 and link as any other. Repeated rows are
    kept and share their class. A null doc_id is kept and never names a class,
    unless all of the class are null. An empty table gives an empty result;
    other columns of ``docs``, whatever their names, are ignored. Texts may have
    any length; one at a time is held, with its shingles' hashes.
    """
    prints = store(fingerprints(docs, shingle_words), "fingerprints")
    return prints.join(_classes(prints, max_bits), "fp").select(
        "doc_id", "fp", hex_fingerprint(F.col("fp")).alias("fingerprint"), "group", "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each class: that with its smallest doc_id, nulls last.

    Ties in doc_id are broken by a hash of the text; rows equal in both count
    as one. All columns of ``docs`` are returned as they are.
    """
    key = text_key("doc_id", "text")
    keyed = docs.select("doc_id", "text", *key)
    prints = store(fingerprints(keyed, shingle_words, ("doc_id", "key_a", "key_b")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key_a", "key_b")
    first = prints.join(_classes(prints, max_bits), "fp").groupBy("group").agg(F.min(order).alias("first"))
    chosen = first.select("first.key_a", "first.key_b")
    rows = docs.select(F.struct("*").alias("row"), *key).join(chosen, ["key_a", "key_b"], "left_semi")
    return rows.dropDuplicates(["key_a", "key_b"]).select("row.*")
