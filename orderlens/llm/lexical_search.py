"""Ranked lexical search: accumulators from short lists, then skipping over long ones.

``build_index`` inverts documents segment by segment, each in one task: a
segment holds some millions of tokens of whole documents, numbered in order of
doc_id, and gives a row per term with the documents that hold it and how often,
and a row with the documents' ids and lengths. The index holds every document
and term, and is a stored table like any other.

``search`` takes the lists of the items' terms only. Per segment and item, the
short lists are summed term by term into accumulators. These then act as one
more list, whose bound is the largest sum, in a pass over the long lists
document by document: spans of documents whose bounds do not reach the score
of the k-th document so far are skipped, lists too weak to matter on their own
only look up documents that others brought, and a document is given up as soon
as what is left cannot lift it. Tasks keep the best documents of all their
segments, and a window over these gives the ranks.

All scores are 64-bit integers, so neither segments nor tasks show in them.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.common import map_rows
from orderlens.session import store

# A segment is closed when it has so many postings or documents.
SEGMENT_POSTINGS = 3_000_000
SEGMENT_DOCUMENTS = 1 << 16
# Terms whose lists leave a task at a time.
TERMS_PER_BATCH = 20_000
# Bytes of a text whose terms are counted at a time.
PIECE_BYTES = 1 << 20

TOP = 20
# Items are searched in blocks of about so many (item, term) pairs; a block's pairs go to every task.
BLOCK_PAIRS = 200_000
# A list is short if it holds under one in so many of the segment's documents.
SHORT_SHARE = 64
# Documents between two looks at the bounds.
SPAN = 1024

# Terms are what is left between ASCII characters other than letters and digits; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")

POSTINGS = "segment bigint, term string, places array<int>, counts array<int>, doc_ids array<bigint>"


@dataclass(frozen=True)
class Index:
    """The segments' lists; rows without a term hold a segment's doc_ids and the documents' lengths in ``counts``."""

    rows: DataFrame

    def lists(self) -> DataFrame:
        return self.rows.filter("term is not null").drop("doc_ids")

    def documents(self) -> DataFrame:
        return self.rows.filter("term is null")

    def totals(self) -> tuple[int, int]:
        """The number of documents with a term, and of all their terms."""
        terms = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        row = self.documents().agg(F.sum(F.size("counts")), F.sum(terms)).first()
        return int(row[0] or 0), int(row[1] or 0)


def _pieces(data: bytes, step: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``step`` bytes, none of which ends within a term."""
    start = 0
    while start < len(data):
        end = start + step
        if end < len(data):
            edge = _BETWEEN.search(data, end)
            end = edge.start() if edge else len(data)
        yield data[start:end]
        start = end


def count_terms(text: str, step: int = PIECE_BYTES) -> Counter:
    """How often each term stands in the text."""
    found: Counter = Counter()
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z
    for piece in _pieces(data, step):
        found.update(_TERM_BYTES.findall(piece))
    return found


class Segment:
    """Documents on their way into the index."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths, self.widths = array("q"), array("q")
        self.of, self.counts = array("i"), array("i")

    def add(self, doc_id: int | None, found: Counter) -> None:
        known = self.terms
        self.ids.append(doc_id)
        self.lengths.append(found.total())
        self.widths.append(len(found))
        self.of.extend([known.setdefault(term, len(known)) for term in found])
        self.counts.extend(found.values())

    def full(self) -> bool:
        return len(self.of) >= SEGMENT_POSTINGS or len(self.ids) >= SEGMENT_DOCUMENTS

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The segment's rows, documents in order of doc_id, nulls last."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        lengths = np.array(self.lengths)[order]
        documents = {"segment": number, "term": None, "places": None, "counts": lengths.tolist(), "doc_ids": [self.ids[i] for i in order]}
        yield pa.RecordBatch.from_pylist([documents], schema=schema)
        of, counts = np.frombuffer(self.of, np.int32), np.frombuffer(self.counts, np.int32)
        places = np.repeat(rank, np.array(self.widths))
        by_term = np.lexsort((places, of))
        places, counts = places[by_term], counts[by_term]
        ends = np.cumsum(np.bincount(of, minlength=len(self.terms)))
        offsets = np.concatenate(([0], ends))
        names = list(self.terms)
        for first in range(0, len(names), TERMS_PER_BATCH):
            some = names[first : first + TERMS_PER_BATCH]
            edges = offsets[first : first + len(some) + 1]
            within = pa.array((edges - edges[0]).astype(np.int32))
            values = slice(edges[0], edges[-1])
            columns = [
                pa.array(np.full(len(some), number)),
                pa.array(some, pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(within, pa.array(places[values])),
                pa.ListArray.from_arrays(within, pa.array(counts[values])),
                pa.nulls(len(some), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def build_index(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text), stored.

    Null texts and texts without a term are not in it. Rows are documents of
    their own, repeated ones too. Texts may have any length; one with more
    postings than a segment is a segment by itself.
    """
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("term", pa.string()),
            ("places", pa.list_(pa.int32())),
            ("counts", pa.list_(pa.int32())),
            ("doc_ids", pa.list_(pa.int64())),
        ]
    )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The partition's number makes the segment's unique; a task that runs anew gives the same.
        number, segment = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                found = count_terms(text.as_py())
                if found:
                    segment.add(doc_id.as_py(), found)
                    if segment.full():
                        yield from segment.batches(number, schema)
                        number, segment = number + 1, Segment()
        if segment.ids:
            yield from segment.batches(number, schema)

    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return Index(store(rows.mapInArrow(invert, POSTINGS), "index"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_key, term, times) from rows of (item_key, text)."""
    lowered = F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL)
    terms = items.select("item_key", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 0)).alias("term"))
    return terms.groupBy("item_key", "term").agg(F.count("*").alias("times"))


def weight(documents: int, holding: Column) -> Column:
    return F.floor(F.log(F.lit(float(2 * documents + 2)) / (holding * 2 + 1).cast("double")) * 1000).cast("long")


# ---------------------------------------------------------------- within a task


class List:
    """A term's documents within a segment, with what one occurrence in an item is worth in each."""

    def __init__(self, places: np.ndarray, worth: np.ndarray, spans: int) -> None:
        self.places, self.worth = places, worth
        self.starts = np.searchsorted(places, np.arange(spans + 1) * SPAN)
        self.most = int(worth.max())
        # The largest of every span.
        self.peaks = np.zeros(spans, np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        self.peaks[full] = np.maximum.reduceat(worth, self.starts[full])


class Best:
    """The k best documents of an item so far: by score, then smallest doc_id, nulls last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []
        self.least = 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        rows = [(-score, i is None, i or 0) for score, i in zip(scores.tolist(), ids)]
        self.rows = sorted(self.rows + rows)[: self.k]
        if len(self.rows) == self.k:
            # A document with the same score may still have a smaller id.
            self.least = max(1, -self.rows[-1][0])


def accumulate(lists: list[tuple[List, int]], spans: int) -> List | None:
    """The sums of short lists, term by term, as one list."""
    if not lists:
        return None
    places = np.concatenate([x.places for x, _ in lists])
    worth = np.concatenate([x.worth * factor for x, factor in lists])
    found, at = np.unique(places, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, worth)
    return List(found, sums, spans)


def rank_segment(terms: list[tuple[List, int]], ids: list[int | None], best: Best) -> int:
    """Take a segment's documents into ``best``; how many documents were scored.

    ``terms`` are the item's lists with the factor of each.
    """
    n = len(ids)
    spans = -(-n // SPAN)
    short = [(x, factor) for x, factor in terms if len(x.places) * SHORT_SHARE < n]
    long = [(x, factor) for x, factor in terms if len(x.places) * SHORT_SHARE >= n]
    summed = accumulate(short, spans)
    lists = ([(summed, 1)] if summed else []) + long
    lists.sort(key=lambda x: x[0].most * x[1])
    # What the lists up to each can give at most, in all and in every span.
    bounds = np.cumsum([x.most * factor for x, factor in lists])
    peaks = np.cumsum([x.peaks * factor for x, factor in lists], axis=0)
    scored = 0
    for span in range(spans):
        if peaks[-1, span] < best.least:
            continue
        # Lists that cannot reach the k-th score together bring no documents of their own.
        weak = int(np.searchsorted(np.minimum(bounds, peaks[:, span]), best.least))
        base = span * SPAN
        sums = np.zeros(min(SPAN, n - base), np.int64)
        for x, factor in lists[weak:]:
            a, b = x.starts[span], x.starts[span + 1]
            sums[x.places[a:b] - base] += x.worth[a:b] * factor
        found = np.flatnonzero(sums)
        for k in range(weak - 1, -1, -1):
            found = found[sums[found] + min(bounds[k], peaks[k, span]) >= best.least]
            if not len(found):
                break
            x, factor = lists[k]
            a, b = x.starts[span], x.starts[span + 1]
            at = np.searchsorted(x.places[a:b], found + base)
            there = at < b - a
            there[there] = x.places[a:b][at[there]] == found[there] + base
            sums[found[there]] += x.worth[a:b][at[there]] * factor
        scored += len(found)
        found = found[sums[found] >= best.least]
        if len(found) > 4 * best.k:
            # Ties with the k-th stay.
            found = found[sums[found] >= np.partition(sums[found], -best.k)[-best.k]]
        if len(found):
            best.add(sums[found], [ids[i] for i in (found + base).tolist()])
    return scored


Queries = dict[int, list[tuple[str, int]]]


def _search_block(index: Index, lists: DataFrame, queries: Queries, documents: int, total: int, k: int) -> DataFrame:
    """(item_key, doc_id, score): every task's best documents for each of the block's items."""
    wanted = {term for terms in queries.values() for term, _ in terms}

    def rank(segment: list[dict], best: dict[int, Best]) -> None:
        head = segment[0]
        ids, lengths = head["doc_ids"], np.array(head["counts"], np.int64)
        base = 12 * (75 + 25 * lengths * documents // total)
        spans, found = -(-len(ids) // SPAN), {}
        for row in segment[1:]:
            places, counts = row["places"].astype(np.int64), row["counts"].astype(np.int64)
            found[row["term"]] = List(places, 1_000_000_000 * counts // (1000 * counts + base[places]), spans)
        for key, terms in queries.items():
            own = [(found[term], factor) for term, factor in terms if term in found and factor > 0]
            if own:
                rank_segment(own, ids, best.setdefault(key, Best(k)))

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        best: dict[int, Best] = {}
        held: list[dict] = []
        for row in rows:
            if held and held[0]["segment"] != row["segment"]:
                rank(held, best)
                held = []
            if row["term"] is None:
                held.append(row)
            elif row["term"] in wanted:
                held.append(row | {c: np.array(row[c], np.int32) for c in ("places", "counts")})
        if held:
            rank(held, best)
        for key, top in best.items():
            for score, missing, doc_id in top.rows:
                yield {"item_key": key, "doc_id": None if missing else doc_id, "score": -score}

    rows = index.documents().unionByName(lists.withColumn("doc_ids", F.lit(None).cast("array<bigint>")))
    # A segment's documents come before its lists.
    dealt = rows.repartition("segment").sortWithinPartitions("segment", F.col("term").isNotNull())
    return map_rows(dealt, work, "item_key bigint, doc_id bigint, score bigint")


def _blocks(spark: SparkSession, pairs: DataFrame) -> Iterator[Queries]:
    """The items in blocks of about ``BLOCK_PAIRS`` (item, term) pairs, dealt by hash; each is fetched by itself."""
    parts = max(1, -(-pairs.count() // BLOCK_PAIRS))
    part = F.pmod(F.xxhash64("item_key"), F.lit(parts))
    for number in range(parts):
        found: Queries = {}
        for row in pairs.filter(part == number).collect():
            found.setdefault(row["item_key"], []).append((row["term"], row["factor"]))
        if found:
            yield found


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0.

    A term's weight falls with the documents that hold it, and its worth in a
    document grows with its occurrences and falls with the document's length
    (see ``weight`` and ``_search_block``). Documents with equal scores come in
    order of doc_id, nulls last.

    Items (item_id, text) that are equal in both are one item; rows that share
    only the item_id are ranked each by itself. Null and empty texts, and
    items without a term that the index has, get no rows, as do all items if
    the index is empty. Repeated documents are ranked one by one. Items are
    searched in blocks; memory holds a block's terms, so an item's distinct
    terms are what bounds it from below. Other columns are ignored.
    """
    spark = items.sparkSession
    numbered = store(items.select("item_id", "text").distinct().withColumn("item_key", F.monotonically_increasing_id()), "items")
    asked = store(item_terms(numbered), "item_terms")
    # Join sides are stored, so that a small set of terms is broadcast by its size and a large one is not.
    terms = store(asked.select("term").distinct(), "terms")
    lists = store(index.lists().join(terms, "term"), "lists")
    documents, total = index.totals()
    holding = lists.groupBy("term").agg(F.sum(F.size("places")).alias("holding"))
    factor = F.col("times") * weight(documents, F.col("holding"))
    pairs = store(asked.join(holding, "term").select("item_key", "term", factor.alias("factor")), "pairs")
    schema = "item_key bigint, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for queries in _blocks(spark, pairs):
        found = found.unionByName(store(_search_block(index, lists, queries, documents, total, k), "ranked"))
    order = Window.partitionBy("item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")
