"""Exact repeated passages, by enhanced suffix arrays over anchored contexts.

A byte is repeated if a string of ``min_bytes`` that covers it also starts
anywhere else, in the same text or another. Suffixes are thinned first, without
loss: of every ``min_bytes`` window the leftmost 100-byte gram (a quarter of
the window) with the smallest hash is its anchor, so equal windows have equal
anchors at the same place. Only anchors whose gram occurs again go on, each
with its context: all bytes of the windows that share it.

Equal contexts are counted, not compared. Different contexts around one gram
form a group. Over the group's right strings an enhanced suffix array (sorted
suffixes with common-prefix lengths) is scanned with a stack, which yields its
tree of common-prefix intervals. In each interval the members' left strings
are scanned alike: a class whose members' left extensions differ, and that
holds members of several child intervals, is a maximal repeat, given with all
its occurrences. Repeats longer than a context appear once per anchor, and
their spans merge.

A group with more than ``GROUP`` different contexts is regrouped by ever
longer shared parts of them and, in the end, by whole windows, which need only
be counted; no group grows with the data.

Text is taken as UTF-8 bytes; matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import map_rows, text_key
from orderlens.session import store

MIN_BYTES = 400
# Different contexts that one task scans at a time; with up to 700 bytes each, some 40 MB. Regrouping by longer parts
# multiplies contexts, so smaller groups cost more disk than they save time.
GROUP = 60_000
# Bytes whose anchors are chosen at a time; positions within fit 20 bits.
CHUNK = 500_000

KEY = ["key_a", "key_b"]
CONTEXT = ["h", "c_a", "c_b"]

_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Chooses the anchors of a text."""

    def __init__(self, min_bytes: int = MIN_BYTES) -> None:
        self.min_bytes, self.gram = min_bytes, max(1, min_bytes // 4)
        self.window = min_bytes - self.gram + 1
        size = CHUNK + min_bytes + 1
        self.up = _powers(_BASE, size)
        self.down = _powers(pow(_BASE, -1, 1 << 64), size)

    def _hashes(self, part: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], dtype=np.uint64)))
        n = len(part) - self.gram + 1
        return _mixed((sums[self.gram :] - sums[:n]) * self.down[:n])

    def _least(self, values: np.ndarray) -> np.ndarray:
        """The least value of every window, from running minima within blocks, ahead and back."""
        n, w = len(values), self.window
        padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = values
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: n - w + 1], ahead[w - 1 : n])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram hashes (as signed longs) of the anchors."""
        array, places, hashes = np.frombuffer(data, np.uint8), [], []
        for start in range(0, len(data) - self.min_bytes + 1, CHUNK):
            grams = self._hashes(array[start : start + CHUNK + self.min_bytes - 1])
            tagged = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
            chosen = np.unique(self._least(tagged) & _POSITION).astype(np.int64)
            places.append(chosen + start)
            hashes.append(grams[chosen])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[first].view(np.int64)


# ---------------------------------------------------------------- enhanced suffix array


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring rows."""
    if len(rows) < 2:
        return np.empty(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings])
    width = max(1, int(sizes.max()))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), sizes


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all common-prefix intervals of at least ``least``, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for at, value in enumerate([*common, -1]):
        start = at
        while stack and stack[-1][0] > value:
            length, start = stack.pop()
            yield length, start, at
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, start))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left length, right length, members) of all maximal repeats of ``least`` bytes or more.

    ``rights`` are the strings from the anchor on, ``lefts`` those before it,
    reversed; members are indexes into them.
    """
    n = len(rights)
    if n < 2:
        return
    order = sorted(range(n), key=rights.__getitem__)
    right, right_sizes = _matrix([rights[i] for i in order])
    common = _common(right, right_sizes)
    left, left_sizes = _matrix(lefts)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lefts.__getitem__)] = np.arange(n)
    order = np.array(order)
    for length, first, last in intervals(common.tolist(), max(1, least - int(left_sizes.max()))):
        members = order[first : last + 1]
        child = np.concatenate(([0], np.cumsum(common[first:last] == length)))
        by_left = np.argsort(rank[members], kind="stable")
        members, child = members[by_left], child[by_left]
        shared = _common(left[members], left_sizes[members])
        if not len(shared) or shared.max() + length < least:
            continue
        for extent, a, b in intervals(shared.tolist(), max(0, least - length)):
            if (child[a : b + 1] != child[a]).any():
                yield extent, length, members[a : b + 1]


# ---------------------------------------------------------------- stages


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _marked(docs: DataFrame, min_bytes: int) -> DataFrame:
    """Stored rows (doc_id, key, text, marks): marks are the anchors whose gram occurs again."""

    def choose(rows: Iterator[dict]) -> Iterator[dict]:
        anchors = Anchors(min_bytes)
        for row in rows:
            places, hashes = anchors(_bytes(row["text"]))
            if len(places):
                yield {"key_a": row["key_a"], "key_b": row["key_b"], "pos": places.tolist(), "h": hashes.tolist()}

    keyed = docs.select("doc_id", "text", *text_key("doc_id", "text"))
    listed = map_rows(
        keyed.select("text", *KEY), choose, "key_a bigint, key_b bigint, pos array<bigint>, h array<bigint>"
    )
    anchors = store(listed.select(*KEY, F.explode(F.arrays_zip("pos", "h")).alias("m")).select(*KEY, "m.*"), "anchors")
    # Stored, so that the join is between freshly shuffled sides and a frequent anchor's partition can be split.
    again = store(anchors.groupBy("h").count().filter("count > 1").select("h"), "again")
    marks = anchors.join(again, "h").groupBy(*KEY).agg(F.collect_set(F.struct("pos", "h")).alias("marks"))
    joined = keyed.join(marks, KEY, "left")
    size, digest = F.octet_length(F.coalesce("text", F.lit(""))), F.sha2(F.coalesce("text", F.lit("")), 256)
    none = F.col("marks").isNull()
    return store(
        joined.select(
            "doc_id",
            *KEY,
            F.when(~none, F.col("text")).alias("text"),
            "marks",
            size.cast("long").alias("n_bytes"),
            F.when(none, digest).alias("sha256"),
        ),
        "marked",
    )


def _occurrences(marked: DataFrame, min_bytes: int) -> DataFrame:
    """Stored rows, one per anchor: its context's hash and extent on both sides."""
    reach = min_bytes - max(1, min_bytes // 4)

    def contexts(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            data = _bytes(row["text"])
            out = {"key_a": row["key_a"], "key_b": row["key_b"]} | {c: [] for c in ("h", "c_a", "c_b", "pos", "l", "r")}
            for mark in row["marks"]:
                at = mark["pos"]
                left, right = min(at, reach), min(len(data) - at, min_bytes)
                digest = xxhash.xxh3_128_digest(left.to_bytes(4, "big") + data[at - left : at + right])
                for name, value in zip(
                    ("h", "c_a", "c_b", "pos", "l", "r"),
                    (mark["h"], *np.frombuffer(digest, ">i8").tolist(), at, left, right),
                ):
                    out[name].append(value)
            yield out

    names = ["h", "c_a", "c_b", "pos", "l", "r"]
    kinds = ", ".join(f"{n} array<bigint>" for n in names)
    listed = map_rows(
        marked.filter("marks is not null").select(*KEY, "text", "marks"), contexts, f"key_a bigint, key_b bigint, {kinds}"
    )
    rows = listed.select(*KEY, F.explode(F.arrays_zip(*names)).alias("m")).select(*KEY, "m.*")
    return store(rows, "occurrences")


def _texts(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contexts' bytes, read from one text each: (h, c_a, c_b, left, right)."""

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            data = _bytes(row["text"])
            for want in row["wanted"]:
                at = want["pos"]
                yield {
                    "h": want["h"],
                    "c_a": want["c_a"],
                    "c_b": want["c_b"],
                    "left": data[at - want["l"] : at][::-1],
                    "right": data[at : at + want["r"]],
                }

    lists = wanted.groupBy(*KEY).agg(F.collect_set(F.struct("h", "c_a", "c_b", "pos", "l", "r")).alias("wanted"))
    texts = marked.filter("marks is not null").select(*KEY, "text").dropDuplicates(KEY)
    schema = "h bigint, c_a bigint, c_b bigint, left binary, right binary"
    return map_rows(texts.join(lists, KEY).select("text", "wanted"), cut, schema)


def _refined(contexts: DataFrame, min_bytes: int, unit: int) -> DataFrame:
    """(g, h, c_a, c_b): the contexts grouped by parts of ``min_bytes - unit`` bytes, without their bytes.

    Any window that two contexts share holds such a part at one of the places
    tried, so windows still meet in some group.
    """
    gram = max(1, min_bytes // 4)
    reach = min_bytes - gram

    def parts(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            for before in range(0, reach - unit + 1, unit):
                after = gram + reach - unit - before
                if len(row["left"]) >= before and len(row["right"]) >= after:
                    part = row["left"][:before] + b"|" + row["right"][:after]
                    g = np.uint64(xxhash.xxh64_intdigest(part, before)).view(np.int64)
                    yield {c: row[c] for c in CONTEXT} | {"g": int(g)}

    return map_rows(contexts, parts, "g bigint, h bigint, c_a bigint, c_b bigint")


def _windows(contexts: DataFrame, min_bytes: int) -> DataFrame:
    """Extents of contexts whose windows are counted whole."""

    def windows(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            data, at = row["left"][::-1] + row["right"], len(row["left"])
            for start in range(len(data) - min_bytes + 1):
                digest = xxhash.xxh3_128_digest(data[start : start + min_bytes])
                a, b = np.frombuffer(digest, ">i8").tolist()
                yield {"h": row["h"], "c_a": row["c_a"], "c_b": row["c_b"], "w_a": a, "w_b": b, "j": at - start}

    schema = "h bigint, c_a bigint, c_b bigint, w_a bigint, w_b bigint, j bigint"
    rows = store(map_rows(contexts.select(*CONTEXT, "left", "right"), windows, schema), "windows")
    # A window stands in the contexts of all grams within it, so it is counted per gram and place of the gram.
    window = ["h", "j", "w_a", "w_b"]
    again = rows.groupBy(*window).count().filter("count > 1").select(*window)
    return rows.join(again, window).select(*CONTEXT, F.col("j").alias("l"), (min_bytes - F.col("j")).alias("r"), "w_a", "w_b")


def _repeats(groups: DataFrame, min_bytes: int, every: bool) -> DataFrame:
    """(h, c_a, c_b, g, repeat, l, r): members of each group's maximal repeats.

    With ``every`` a row per repeat and member; otherwise a row per member,
    with the farthest that any of its repeats reach to the left and right.
    """

    def solve(held: list[dict]) -> Iterator[dict]:
        rights, lefts = [x["right"] for x in held], [x["left"] for x in held]
        found = enumerate(maximal_repeats(rights, lefts, min_bytes))
        if every:
            rows = ((i, number, l, r) for number, (l, r, members) in found for i in members.tolist())
        else:
            far = np.zeros((2, len(held)), dtype=np.int64)
            for _, (l, r, members) in found:
                far[0, members] = np.maximum(far[0, members], l)
                far[1, members] = np.maximum(far[1, members], r)
            rows = ((i, 0, int(far[0, i]), int(far[1, i])) for i in np.flatnonzero(far[1]).tolist())
        for i, number, l, r in rows:
            yield {c: held[i][c] for c in CONTEXT} | {"repeat": number, "g": held[i]["g"], "l": l, "r": r}

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []
        for row in rows:
            if held and held[0]["g"] != row["g"]:
                yield from solve(held)
                held = []
            held.append(row)
        yield from solve(held)

    schema = "h bigint, c_a bigint, c_b bigint, g bigint, repeat bigint, l bigint, r bigint"
    return map_rows(groups.repartition("g").sortWithinPartitions("g"), work, schema)


def _extents(marked: DataFrame, occurrences: DataFrame, min_bytes: int, group: int, every: bool = False) -> DataFrame:
    """(h, c_a, c_b, l, r, g, repeat): every context's part in maximal repeats, see ``_repeats``."""
    at = F.min(F.struct("key_a", "key_b", "pos")).alias("at")
    contexts = store(
        occurrences.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min("l").alias("l"), F.min("r").alias("r"), at),
        "contexts",
    )
    mixed = store(contexts.groupBy("h").count().filter("count > 1").select("h"), "mixed")
    wanted = contexts.join(mixed, "h").select(*CONTEXT, "l", "r", "at.*")
    texts = store(_texts(marked, wanted), "texts")
    whole = contexts.filter("n > 1").select(
        *CONTEXT, F.xxhash64(*CONTEXT).alias("g"), F.lit(-1).cast("long").alias("repeat"), "l", "r"
    )
    reach = min_bytes - max(1, min_bytes // 4)
    groups = texts.select(F.col("h").alias("g"), *CONTEXT)
    for unit in [u for u in (reach // 4, reach // 20) if u > 0] + [0]:
        sizes = groups.groupBy("g").count()
        large = store(sizes.filter(F.col("count") > group).select("g"), "large")
        small = groups.join(sizes.filter(F.col("count").between(2, group)).select("g"), "g").join(texts, CONTEXT)
        whole = whole.unionByName(store(_repeats(small, min_bytes, every), "repeats"))
        if large.isEmpty():
            return whole
        # The contexts of crowded groups go on, each once.
        crowded = groups.join(large, "g").select(*CONTEXT).distinct()
        texts = store(texts.join(crowded, CONTEXT), "texts")
        if unit:
            groups = store(_refined(texts, min_bytes, unit), "groups")
    counted = _windows(texts, min_bytes)
    # Named by the window, which all contexts that hold it there share.
    own = counted.withColumns({"g": F.xxhash64("h", "l", "w_a", "w_b"), "repeat": F.lit(-2).cast("long")})
    return whole.unionByName(own.drop("w_a", "w_b"))


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, group: int = GROUP) -> DataFrame:
    """(repeat_id, doc_id, key_a, key_b, start, length): maximal repeats with all occurrences.

    Starts and lengths are in bytes; a repeat that reaches beyond its anchors'
    contexts is given in overlapping parts. (key_a, key_b) names the row.
    """
    marked = _marked(docs, min_bytes)
    occurrences = _occurrences(marked, min_bytes)
    extents = _extents(marked, occurrences, min_bytes, group, True).withColumnsRenamed({"l": "x", "r": "y"})
    rows = occurrences.join(extents, CONTEXT)
    names = marked.select("doc_id", *KEY).distinct()
    return rows.join(names, KEY).select(
        F.xxhash64("g", "repeat").alias("repeat_id"),
        "doc_id",
        *KEY,
        (F.col("pos") - F.col("x")).alias("start"),
        (F.col("x") + F.col("y")).alias("length"),
    )


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept.

    Every byte that a string of ``min_bytes`` covers which also starts
    elsewhere is removed, all its occurrences alike. ``spans`` lists the
    removed runs as (start, end); ``kept`` holds the remaining bytes where any
    were removed, else null. A null or empty text has 0 bytes and the hash of
    nothing. Rows that are wholly equal are copies of one another, so all they
    have in common goes. A null doc_id is a value like any other. An empty
    table gives an empty result; other columns are ignored.
    """
    marked = _marked(docs, min_bytes)
    occurrences = _occurrences(marked, min_bytes)
    extents = _extents(marked, occurrences, min_bytes, group)
    widest = store(extents.groupBy(*CONTEXT).agg(F.max("l").alias("x"), F.max("r").alias("y")), "widest")
    spans = occurrences.join(widest, CONTEXT).select(
        *KEY, F.struct((F.col("pos") - F.col("x")).alias("s"), (F.col("pos") + F.col("y")).alias("e")).alias("span")
    )
    lists = spans.groupBy(*KEY).agg(F.sort_array(F.collect_set("span")).alias("found"))

    def remove(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            data, runs = _bytes(row["text"]), []
            for span in row["found"] or []:
                if runs and span["s"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span["e"])
                else:
                    runs.append([span["s"], span["e"]])
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            yield {
                "doc_id": row["doc_id"],
                "n_bytes": len(data),
                "n_removed": len(data) - len(kept),
                "n_spans": len(runs),
                "spans": [{"start": a, "end": b} for a, b in runs],
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
                "kept": kept if runs else None,
            }

    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary"
    )
    touched = marked.filter("marks is not null").join(lists, KEY, "left").select("doc_id", "text", "found")
    zero = F.lit(0).cast("long")
    rest = marked.filter("marks is null").select(
        "doc_id",
        "n_bytes",
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("sha256").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return map_rows(touched, remove, schema).unionByName(rest)
