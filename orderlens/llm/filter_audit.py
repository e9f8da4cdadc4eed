"""How text filters interact: what each removes, alone and after the others.

One pass of a finite-state transducer over the bytes of the texts counts
words, capitals, code points and symbols. Its tables give, for the state
(outside or inside a word) and the next byte, the state that follows and what
the byte means. Word spans go into a hash table with open addressing; a span
that meets one with the same hash is compared byte by byte, so the distinct
words are counted exactly. Long texts are passed through piece by piece, cut
at white space; the table lives as long as its text.

Texts equal to one with a smaller doc_id are found by their SHA-256. The set
of filters that a text fails is then all that matters: texts are counted by
part and set, and what every order of the filters removes at every step
follows from these counts, at most 2 to the number of filters a part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.words import Block, mixed
from orderlens.session import store

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"

# Bytes that are passed through at a time.
BLOCK_BYTES = 1 << 20

_SPACES = b" \t\n\x0b\x0c\r"

# What the transducer says of a byte.
START, END, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8, 16
OUTSIDE, INSIDE = 0, 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state that follows a state and a byte, and what is said meanwhile."""
    follows, says = np.zeros((2, 256), np.uint8), np.zeros((2, 256), np.uint8)
    for state in (OUTSIDE, INSIDE):
        for byte in range(256):
            space = byte in _SPACES
            follows[state, byte] = OUTSIDE if space else INSIDE
            edge = (END if space else 0) if state == INSIDE else (0 if space else START)
            capital = CAPITAL if 0x41 <= byte <= 0x5A else 0
            symbol = SYMBOL if byte in SYMBOLS else 0
            # Bytes 80 to BF continue a code point.
            point = 0 if byte & 0xC0 == 0x80 else POINT
            says[state, byte] = edge | capital | symbol | point
    return follows, says


FOLLOWS, SAYS = _tables()


class WordTable:
    """The distinct words of texts, by open addressing, compared by bytes."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.slots = np.full(1024, -1, np.int64)
        self.texts = self.starts = self.lengths = np.empty(0, np.int64)
        self.hashes = np.empty(0, np.uint64)

    def _place(self, first: int, compare: bool) -> np.ndarray:
        """Put the entries from ``first`` on into the slots; the slot of each, -1 if an equal one is there."""
        mask = len(self.slots) - 1
        pending = np.arange(first, len(self.hashes))
        at = (self.hashes[first:] & np.uint64(mask)).astype(np.int64)
        found = np.full(len(pending), -1, np.int64)
        while len(pending):
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]
            owner = self.slots[at]
            mine = owner == pending
            found[pending[mine] - first] = at[mine]
            left = ~mine
            if compare:
                alike = left & (self.hashes[owner] == self.hashes[pending])
                alike &= (self.texts[owner] == self.texts[pending]) & (self.lengths[owner] == self.lengths[pending])
                some = np.flatnonzero(alike)
                equal = self.block.same(self.starts[owner[some]], self.starts[pending[some]], self.lengths[owner[some]])
                left[some[equal]] = False
            pending, at = pending[left], (at[left] + 1) & mask
        return found

    def insert(self, texts: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The texts of those words that were not there before, one for each."""
        first = len(self.hashes)
        hashes = mixed(self.block.hashes(starts, lengths) + texts.astype(np.uint64))
        room = 2 * (first + len(hashes))
        if room > len(self.slots):
            self.slots = np.full(1 << (room - 1).bit_length(), -1, np.int64)
            self._place(0, compare=False)
        for name, values in (("texts", texts), ("starts", starts), ("lengths", lengths), ("hashes", hashes)):
            setattr(self, name, np.concatenate((getattr(self, name), values)))
        slot = self._place(first, compare=True)
        new = np.flatnonzero(slot >= 0)
        # Only the new entries are kept, and move together.
        self.slots[slot[new]] = first + np.arange(len(new))
        for name in ("texts", "starts", "lengths", "hashes"):
            values = getattr(self, name)
            setattr(self, name, np.concatenate((values[:first], values[first + new])))
        return texts[new]


def _cuts(data: bytes, step: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of about ``step`` bytes that end after white space, or after a longer word."""
    start = 0
    while start < len(data):
        end = min(len(data), start + step)
        if end < len(data):
            last = max(data.rfind(bytes([s]), start, end) for s in _SPACES)
            if last < 0:
                ahead = [at for at in (data.find(bytes([s]), end) for s in _SPACES) if at >= 0]
                last = min(ahead, default=len(data) - 1)
            end = last + 1
        yield start, end
        start = end


def count_texts(texts: Sequence[bytes], step: int = BLOCK_BYTES) -> np.ndarray:
    """A row per text: words, distinct words, capitals, code points, symbols."""
    # A line feed after each text ends its last word.
    block = Block(b"\n".join(texts) + b"\n")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    found = np.zeros((len(texts), 5), np.int64)
    table = WordTable(block)
    for start, end in _cuts(block.data[: block.size], step):
        part = block.bytes[start:end]
        # What follows depends on the byte alone, so all states are looked up at once; pieces end outside of words.
        states = np.concatenate((np.array([OUTSIDE], np.uint8), FOLLOWS[OUTSIDE][part[:-1]]))
        said = SAYS.ravel()[(states.astype(np.int16) << 8) | part]
        starts = np.flatnonzero(said & START) + start
        lengths = np.flatnonzero(said & END) + start - starts
        of = np.searchsorted(begins, starts, "right") - 1
        found[:, 0] += np.bincount(of, minlength=len(texts))
        found[:, 1] += np.bincount(table.insert(of, starts, lengths), minlength=len(texts))
        first, last = np.searchsorted(ends, start), min(len(texts) - 1, np.searchsorted(begins, end - 1, "right") - 1)
        inner = slice(first, last + 1)
        a, b = np.maximum(begins[inner], start) - start, np.minimum(ends[inner], end) - start
        for column, flag in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            sums = np.concatenate(([0], np.cumsum((said & flag) > 0)))
            found[inner, column] += sums[b] - sums[a]
    return found


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def measure(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and the counts of every row's text; a null text counts as empty."""
    names = [f"k{n}" for n in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            parts, held, size = [np.zeros((0, 5), np.int64)], [], 0
            for value in texts:
                data = value.as_py()
                if held and size + len(data) > BLOCK_BYTES:
                    parts.append(count_texts(held))
                    held, size = [], 0
                held.append(data)
                size += len(data)
            if held:
                parts.append(count_texts(held))
            counts = np.concatenate(parts)
            columns = [batch.column(n) for n in names] + [pa.array(np.ascontiguousarray(c)) for c in counts.T]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(keep, names)] + [f"{c} bigint" for c in COUNTS])
    counted = rows.mapInArrow(count, schema)
    return counted.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *COUNTS)


@dataclass(frozen=True)
class Filter:
    """A filter's one-letter name and the condition on the counts and ``is_copy`` under which a text fails."""

    name: str
    fails: Column


def filters() -> list[Filter]:
    words, distinct, capitals = F.col("n_words"), F.col("n_distinct"), F.col("n_capitals")
    return [
        Filter("A", words < MIN_WORDS),
        Filter("B", distinct * 100 < words * MIN_DISTINCT_PERCENT),
        Filter("C", capitals * 100 > F.col("n_points") * MAX_CAPITAL_PERCENT),
        Filter("D", F.col("n_symbols") > 0),
        Filter("E", F.col("is_copy")),
    ]


def failures(docs: DataFrame, tests: Sequence[Filter] | None = None) -> DataFrame:
    """(doc_id, part, the counts, is_copy, fails): one row per row of ``docs``, stored.

    Bit k of ``fails`` says that the row's text fails the k-th filter.
    """
    tests = filters() if tests is None else tests
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), "text"
    )
    counted = store(measure(named, ["doc_id", "part", "sha"]), "counted")
    # Stored, so that a frequent text's rows can be split in the join.
    first = counted.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    again = store(first.filter("first < last").select("sha", "first"), "again")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    judged = counted.join(again, "sha", "left").withColumn("is_copy", copy)
    bits = sum((F.when(t.fails, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return store(judged.select("doc_id", "part", *COUNTS, "is_copy", bits.alias("fails")), "failures")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, 1 if a label of the document says so, else 0."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    joined = rows.join(marks.filter("good + toxic > 0"), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def _total(cells: Column, value: str, counts) -> Column:
    """The sum of a value over the failure sets that ``counts`` picks."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda sofar, c: sofar + F.when(counts(c["fails"]), c[value]).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, tests: Sequence[Filter] | None = None) -> DataFrame:
    """One row per part (``lang``), order of the filters and step, with the texts kept and removed.

    ``removed`` counts the part's texts that the step's filter removes,
    ``redundant`` those that fail it but went earlier, ``unique_fails`` those
    that fail no other, ``kept`` what is left after the step. ``good_lost`` and
    ``toxic_lost`` count the removed ones that ``labels`` calls so; a document
    with several label rows is what any of them says, and labels without a
    doc_id are ignored. ``shapley`` sums the filter's removals over all orders;
    divided by their number it is the filter's Shapley value.

    Null and empty texts have no words and are equal to one another; a null
    ``lang`` is the part ''. A row with a null doc_id is never a copy, and rows
    that tie in doc_id are not copies of one another. Repeated rows count one
    by one. An empty table gives an empty result; other columns are ignored.
    Texts may have any length: a piece and the distinct words are held.
    """
    tests = filters() if tests is None else list(tests)
    rows = _labelled(failures(docs, tests), labels)
    sets = rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    # At most 2 to the number of filters a part.
    cells = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    steps = []
    for order in permutations(range(len(tests))):
        name, before = "".join(tests[k].name for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "own": 1 << k, "before": before})
            before |= 1 << k
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    each = cells.select("part", "cells", F.inline(literal))
    orders = math.factorial(len(tests))

    def removed(fails: Column) -> Column:
        return (fails.bitwiseAND(F.col("own")) != 0) & (fails.bitwiseAND(F.col("before")) == 0)

    def earlier(fails: Column) -> Column:
        return (fails.bitwiseAND(F.col("own")) != 0) & (fails.bitwiseAND(F.col("before")) != 0)

    def kept(fails: Column) -> Column:
        return fails.bitwiseAND(F.col("own").bitwiseOR(F.col("before"))) == 0

    # Of all orders, one in as many as a set has filters puts a given one of them first.
    share = F.aggregate(
        "cells",
        F.lit(0).cast("long"),
        lambda sofar, c: sofar + F.when(c["fails"].bitwiseAND(F.col("own")) != 0, (c["n"] * orders / F.bit_count(c["fails"])).cast("long")).otherwise(0),
    )
    cells = F.col("cells")
    return each.select(
        "part",
        "filter_order",
        "step",
        _total(cells, "n", kept).alias("kept"),
        _total(cells, "n", removed).alias("removed"),
        _total(cells, "n", earlier).alias("redundant"),
        _total(cells, "n", lambda fails: fails == F.col("own")).alias("unique_fails"),
        _total(cells, "good", removed).alias("good_lost"),
        _total(cells, "toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )

