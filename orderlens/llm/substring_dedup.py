"""Substring dedup by relative parsing of documents against indexed reference blocks.

A word goes if a window of ``WINDOW`` words that covers it also starts in a
document with a smaller doc_id. Documents are read as sequences of words;
equal sequences are parsed once, for the smallest doc_id that has them.

Blocks are chosen so that every window two sequences share meets in one of
them. In each window the leftmost run of ``RUN`` words with the least hash is
its anchor, so equal windows have equal anchors at equal places. Around every
anchor that occurs again a sequence gives a piece: all words of the windows
that have this anchor. The distinct pieces around equal anchors are a reference
block. It is indexed by its sorted suffixes, and every piece is parsed greedily
against the pieces of smaller doc_ids: at a place the longest earlier match is
found by binary search; if it has a window's length it is a factor and its span
is a duplicate. The windows that straddle a factor's end lie in no factor, so
parsing goes on at the first of them and not behind the factor.

Blocks with more than ``BLOCK_PIECES`` pieces are cut again, by whole windows:
pieces that share one meet, and need only be compared in doc_id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import WORD, map_rows, row_dicts
from orderlens.llm.words import Block, mixed
from orderlens.session import shuffles_released, store

WINDOW = 13
RUN = 5
# Distinct pieces around equal anchors that one task indexes at a time, of up to 2 * WINDOW - RUN words each.
BLOCK_PIECES = 2_000
# Words whose anchors are chosen at a time; places within fit 20 bits.
CHUNK = 500_000
# Bytes of texts that are read at a time; a longer one is read by itself.
TEXT_BYTES = 1 << 20
# Pieces that a task remembers, so as to give the words of each but once.
REMEMBERED = 100_000

_PLACE = np.uint64((1 << 20) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    return Block(b"".join(words)).hashes(starts, lengths)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:])


def anchors(hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (as signed longs) of the anchors of sequences of words that stand one after another.

    ``sizes`` counts the words of each. Windows lie within a sequence.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    places, found = [], []
    for start in range(0, len(hashes) - window + 1, CHUNK):
        part = hashes[start : start + CHUNK + window - 1]
        runs = np.zeros(len(part) - run + 1, np.uint64)
        for k in range(run):
            runs = runs * _STEP + part[k : k + len(runs)]
        runs = mixed(runs)
        tagged = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
        own = of[start : start + len(part)]
        within = own[: len(part) - window + 1] == own[window - 1 :]
        chosen = np.unique(_least(tagged, window - run + 1)[within] & _PLACE).astype(np.int64)
        places.append(chosen + start)
        found.append(runs[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(found)[first].view(np.int64)


class Texts:
    """Some rows with their texts' words, hashed together, and the anchors of each."""

    def __init__(self, rows: list[dict], window: int, run: int) -> None:
        self.rows = rows
        self.words = [split_words(row["text"]) for row in rows]
        sizes = np.array([len(w) for w in self.words])
        places, hashes = anchors(word_hashes([w for words in self.words for w in words]), sizes, window, run)
        begins = np.cumsum(sizes) - sizes
        edges = np.searchsorted(places, np.append(begins, sizes.sum()))
        # Places count from each text's own first word.
        self.anchors = [(places[a:b] - begin, hashes[a:b]) for a, b, begin in zip(edges, edges[1:], begins)]


def _groups(rows: Iterator[dict]) -> Iterator[list[dict]]:
    held, size = [], 0
    for row in rows:
        n = len(row["text"] or "")
        if held and size + n > TEXT_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


# ---------------------------------------------------------------- relative parsing


class Reference:
    """The words of earlier pieces, by their sorted suffixes of a window's length and more."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.suffixes: list[tuple] = []

    def add(self, words: tuple) -> None:
        for start in range(len(words) - self.window + 1):
            insort(self.suffixes, words[start:])

    def longest(self, words: tuple) -> int:
        """How many words from the first on also stand, in this order, somewhere in the reference."""
        at = bisect_left(self.suffixes, words)
        best = 0
        for other in self.suffixes[max(0, at - 1) : at + 1]:
            n = 0
            for a, b in zip(words, other):
                if a != b:
                    break
                n += 1
            best = max(best, n)
        return best


def parse(words: tuple, reference: Reference) -> list[tuple[int, int]]:
    """(start, end) of the factors of ``words`` that have a window's length, joined where they overlap or touch."""
    spans: list[tuple[int, int]] = []
    at, window = 0, reference.window
    while at + window <= len(words):
        n = reference.longest(words[at:])
        if n < window:
            at += 1
            continue
        if spans and at <= spans[-1][1]:
            spans[-1] = (spans[-1][0], at + n)
        else:
            spans.append((at, at + n))
        # The windows over the factor's end start here.
        at += n - window + 1
    return spans


def parse_block(pieces: list[tuple[tuple, int]], window: int) -> Iterator[list[tuple[int, int]]]:
    """The factors of every piece (words, doc_id), in order of doc_id, against those of smaller doc_ids."""
    reference, waiting, last = Reference(window), [], None
    for words, doc_id in pieces:
        if doc_id != last:
            for earlier in waiting:
                reference.add(earlier)
            waiting, last = [], doc_id
        yield parse(words, reference)
        waiting.append(words)


# ---------------------------------------------------------------- stages

SEQUENCE = ["s_a", "s_b"]
PIECE = ["h", "c_a", "c_b"]
ROW = ["doc", "k"]
SPANS = "array<struct<start:bigint,end:bigint>>"

# Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


def _halves(data: bytes) -> list[int]:
    return np.frombuffer(xxhash.xxh3_128_digest(data), ">i8").tolist()


def _named(docs: DataFrame) -> DataFrame:
    """(doc, k, text): rows by the doc_id's place in the order and a hash of the text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("k"), "text")


def _sequences(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Stored rows (doc, k, s_a, s_b, n_words, sha256, anchors), one per row of ``docs``.

    (s_a, s_b) names the sequence of words; ``anchors`` has the distinct hashes.
    """

    def read(rows: Iterator[dict]) -> Iterator[dict]:
        for some in _groups(rows):
            texts = Texts(some, window, run)
            for row, words, (_, hashes) in zip(some, texts.words, texts.anchors):
                joined = b" ".join(words)
                a, b = _halves(joined)
                yield {
                    "doc": row["doc"],
                    "k": row["k"],
                    "s_a": a,
                    "s_b": b,
                    "n_words": len(words),
                    "sha256": hashlib.sha256(joined).hexdigest(),
                    "anchors": np.unique(hashes).tolist(),
                }

    schema = "doc bigint, k bigint, s_a bigint, s_b bigint, n_words bigint, sha256 string, anchors array<bigint>"
    return store(map_rows(_named(docs), read, schema), "sequences")


def _owners(sequences: DataFrame) -> DataFrame:
    """Stored rows (s_a, s_b, first, first_k): the first row that has a sequence of words."""
    least = F.min(F.struct("doc", "k")).alias("least")
    found = sequences.groupBy(*SEQUENCE).agg(least)
    return store(found.select(*SEQUENCE, F.col("least.doc").alias("first"), F.col("least.k").alias("first_k")), "owners")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` with the text of its row (first, first_k)."""
    on = [F.col("doc") == F.col("first"), F.col("k") == F.col("first_k")]
    return _named(docs).join(wanted, on).drop(*ROW)


def _pieces(docs: DataFrame, sequences: DataFrame, owners: DataFrame, window: int, run: int) -> DataFrame:
    """Stored rows (h, c_a, c_b, s_a, s_b, first, start, n, words): a sequence's pieces around anchors that occur again.

    ``first`` is the smallest doc_id that has the sequence; (c_a, c_b) names
    the piece's ``n`` words and the anchor's place among them. A task gives a
    piece's ``words`` when it first meets it, and later null.
    """
    each = sequences.select("s_a", F.explode("anchors").alias("h"))
    # Stored, so that the join is between freshly shuffled sides and a frequent anchor's partition can be split.
    again = store(each.groupBy("h").count().filter("count > 1").select("h"), "again")
    # Half of a sequence's name will do: anchors of another sequence are not found in its text.
    marks = store(each.join(again, "h").groupBy("s_a").agg(F.collect_set("h").alias("marks")), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for some in _groups(row_dicts(batches)):
            texts = Texts(some, window, run)
            for row, words, (places, hashes) in zip(some, texts.words, texts.anchors):
                marked = np.isin(hashes, np.array(row["marks"], np.int64))
                places, hashes = places[marked], hashes[marked]
                if not len(places):
                    continue
                joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(sizes + 1) - 1
                start, end = np.maximum(0, places - (window - run)), np.minimum(len(words), places + window)
                names, given = [], []
                for a, b, at in zip((ends - sizes)[start].tolist(), ends[end - 1].tolist(), (places - start).tolist()):
                    name = xxhash.xxh3_128_digest(joined[a:b], seed=at)
                    names.append(name)
                    given.append(None if name in known else joined[a:b])
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(name)
                c = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2)
                columns = [hashes, c[:, 0], c[:, 1], *(np.full(len(places), row[x]) for x in (*SEQUENCE, "first")), start, end - start]
                arrays = [pa.array(np.ascontiguousarray(x)) for x in columns] + [pa.array(given, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*PIECE, *SEQUENCE, "first", "start", "n", "words"])

    schema = "h bigint, c_a bigint, c_b bigint, s_a bigint, s_b bigint, first bigint, start bigint, n bigint, words binary"
    texts = _texts(docs, owners.join(marks, "s_a")).select("text", *SEQUENCE, "first", "marks")
    return store(texts.mapInArrow(cut, schema), "pieces")


def _parsed(blocks: DataFrame, window: int) -> DataFrame:
    """(h, c_a, c_b, spans): the factors of the pieces of every block.

    A block lists its pieces' doc_ids and their words apart.
    """

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words = {(p["c_a"], p["c_b"]): tuple(p["words"].split()) for p in row["pieces"] if p["words"] is not None}
            owned = sorted((p["first"], p["c_a"], p["c_b"]) for p in row["pieces"] if p["words"] is None)
            pieces = [(words[a, b], first) for first, a, b in owned]
            for (_, a, b), spans in zip(owned, parse_block(pieces, window)):
                if spans:
                    yield {"h": row["h"], "c_a": a, "c_b": b, "spans": [{"start": x, "end": y} for x, y in spans]}

    return map_rows(blocks, work, f"h bigint, c_a bigint, c_b bigint, spans {SPANS}")


def _by_windows(pieces: DataFrame, window: int) -> DataFrame:
    """(h, c_a, c_b, spans): the windows of ``pieces`` that a piece of a smaller doc_id has, too."""

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words = row["words"].split()
            for start in range(len(words) - window + 1):
                a, b = _halves(b" ".join(words[start : start + window]))
                yield {c: row[c] for c in (*PIECE, "first")} | {"w_a": a, "w_b": b, "at": start}

    schema = "h bigint, c_a bigint, c_b bigint, first bigint, w_a bigint, w_b bigint, at bigint"
    rows = store(map_rows(pieces.select(*PIECE, "first", "words"), cut, schema), "windows")
    least = rows.groupBy("w_a", "w_b").agg(F.min("first").alias("least"), F.max("first").alias("most"))
    again = store(least.filter("least < most").select("w_a", "w_b", "least"), "repeated")
    found = rows.join(again, ["w_a", "w_b"]).filter("least < first")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    # A piece has few windows.
    return found.groupBy(*PIECE).agg(F.collect_list(span).alias("spans"))


def _duplicates(pieces: DataFrame, window: int, block_pieces: int) -> DataFrame:
    """(s_a, s_b, found): every sequence's spans that earlier ones have, unordered, for its first row."""
    distinct = store(pieces.groupBy(*PIECE).agg(F.min("first").alias("first"), F.max("first").alias("last")), "distinct")
    sizes = store(distinct.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    small, large = sizes.filter(F.col("size") <= block_pieces), sizes.filter(F.col("size") > block_pieces)
    worded = pieces.filter("words is not null").select(*PIECE, "words")
    either = distinct.select(*PIECE, "first", F.lit(None).cast("binary").alias("words")).unionByName(worded, allowMissingColumns=True)
    # A block is bounded, so it may be gathered; as a set, as several tasks may give a piece's words.
    blocks = either.join(small, "h").groupBy("h").agg(F.collect_set(F.struct("c_a", "c_b", "first", "words")).alias("pieces"))
    crowded = distinct.join(large, "h").join(worded.dropDuplicates(PIECE), PIECE)
    parsed = _parsed(blocks, window).unionByName(_by_windows(crowded, window))
    # Pieces that later sequences share as they are, or that have factors.
    known = store(
        distinct.select(*PIECE, F.col("first").alias("least"), "last").join(parsed, PIECE, "left").filter("least < last or spans is not null"),
        "known",
    )
    joined = pieces.select(*PIECE, *SEQUENCE, "first", "start", "n").join(known, PIECE)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    spans = F.when(F.col("first") > F.col("least"), whole).otherwise(F.col("spans"))
    moved = F.transform(spans, lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    return joined.select(*SEQUENCE, F.explode(moved).alias("span")).groupBy(*SEQUENCE).agg(F.collect_set("span").alias("found"))


def find_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(doc, k, n_words, n_removed, kept_sha256, spans): one row per row of ``docs`` (doc_id, text).

    ``spans`` lists the removed runs of words as (start, end), null if there is
    none; (doc, k) names the row, see ``_named``.
    """
    with shuffles_released(docs.sparkSession):
        sequences = _sequences(docs, window, run)
        owners = _owners(sequences)
        pieces = _pieces(docs, sequences, owners, window, run)
        found = store(_duplicates(pieces, window, block_pieces), "spans")
        first = store(_removed(docs, owners, found), "removed")
    rows = sequences.drop("anchors").join(first, SEQUENCE)
    # All windows of a sequence that an earlier document has as a whole stand there.
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    own = (F.col("doc") == F.col("first")) & F.col("spans").isNotNull()
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return rows.select(
        *ROW,
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).when(own, F.col("kept_sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(copy, all_words).when(own, F.col("spans")).alias("spans"),
    )


def _removed(docs: DataFrame, owners: DataFrame, found: DataFrame) -> DataFrame:
    """(s_a, s_b, first, n_removed, kept_sha256, spans): what goes from the first row of every sequence."""

    def remove(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            words, spans = split_words(row["text"]), []
            for span in sorted((s["start"], s["end"]) for s in row["found"]):
                if spans and span[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], span[1])
                else:
                    spans.append(list(span))
            edges = [0, *(x for span in spans for x in span), len(words)]
            kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            yield {
                "s_a": row["s_a"],
                "s_b": row["s_b"],
                "n_removed": len(words) - len(kept),
                "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
                "spans": [{"start": a, "end": b} for a, b in spans],
            }

    schema = f"s_a bigint, s_b bigint, n_removed bigint, kept_sha256 string, spans {SPANS}"
    texts = _texts(docs, owners.join(found, SEQUENCE)).select("text", *SEQUENCE, "found")
    # Repeated rows give the same twice.
    removed = map_rows(texts, remove, schema).dropDuplicates(SEQUENCE)
    return owners.select(*SEQUENCE, "first").join(removed, SEQUENCE, "left")


def measure_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): one row per row of ``docs``.

    Every word is removed that a window covers whose words also start in a
    document with a smaller doc_id; the document itself does not count, nor do
    rows with the same doc_id. Windows are judged on the input. ``kept_sha256``
    is that of the kept words joined by one space, ``spans`` has the removed
    runs of words, null if there is none. Null and empty texts have no words
    and the hash of nothing, as have texts of which all goes. Rows with a null
    doc_id come after all others and not before one another. Repeated rows are
    alike. Texts may have any length; one at a time is held. An empty table
    gives an empty result; other columns are ignored.
    """
    doc_id = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    return find_repeats(docs, **options).select(doc_id, "n_words", "n_removed", "kept_sha256", "spans")


def drop_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the texts that lose words made of the kept ones, joined by one space; other texts stay as they are."""
    found = find_repeats(docs, **options).filter("spans is not null").select("doc", "k", "spans").dropDuplicates(ROW)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    named = rows.withColumns({"doc": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)), "k": F.xxhash64(text)})
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    kept = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    joined = named.join(found, ROW, "left")
    values = {"text": F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, " "))}
    return joined.select([values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
