"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A text's lines are hashed, and a rolling hash over each line and the one
before marks some of them; lines without a word do not count. A chunk ends
after a marked line that follows an unmarked one, unless that leaves a single
line before the first or after the last such end. So boundaries depend on
nearby lines only, a passage of lines is cut alike wherever it stands, and
every chunk has two worded lines or more if the text has. A chunk is removed
wherever it repeats, except at its first place (smallest doc_id, then place in
the text): of an exact copy with two worded lines nothing stays. Repeated
chunks are found by two 64-bit hashes and removed if their bytes equal those of
the first.

With ``whole``, pairs take the place of chunks: a line with a word and the next
such line, with the blank ones between. Every passage of two or more worded
lines that stands at an earlier place goes as a whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import text_key
from orderlens.session import store

# A line is marked if its rolling hash, in hex, starts with one of these: 8 of 16, so that a chunk ends every 4 lines.
BOUNDARY = "01234567"
# Worded lines of a chunk, at least.
MIN_LINES = 2

KEYS = ["key_a", "key_b"]
HAS_WORD = r"[^\x20\x09-\x0D]"


def chunks(text: Column) -> Column:
    """The text's chunks, as an array of arrays of lines."""

    def marked(hashes: Column) -> Column:
        def mark(h: Column, at: Column) -> Column:
            rolling = F.md5(F.concat(F.coalesce(F.get(hashes, at - 1), F.lit("")), h))
            return F.substring(rolling, 1, 1).isin(*BOUNDARY)

        return F.transform(hashes, mark)

    def cut(lines: Column, at: Column, marks: Column) -> Column:
        last = F.size(at) - 1
        inner = F.sequence(F.lit(1), F.greatest(last - MIN_LINES, F.lit(1)))
        ends = F.filter(inner, lambda n: (n <= last - MIN_LINES) & F.get(marks, n) & ~F.get(marks, n - 1))
        stops = F.concat(F.transform(ends, lambda n: F.get(at, n)), F.array(F.size(lines) - 1))
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(stops, 1, F.size(stops) - 1), lambda s: s + 1))
        return F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1))

    # One-element arrays bind lines, places, hashes and marks once.
    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.struct(ls.alias("l"), _worded_places(ls).alias("at")))
    hashed = F.transform(bound, lambda s: F.struct(s["l"].alias("l"), s["at"].alias("at"), F.transform(s["at"], lambda n: F.md5(F.get(s["l"], n))).alias("h")))
    marks = F.transform(hashed, lambda s: F.struct(s["l"].alias("l"), s["at"].alias("at"), marked(s["h"]).alias("m")))
    return F.get(F.transform(marks, lambda s: cut(s["l"], s["at"], s["m"])), 0)


def _worded_places(lines: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda n: F.get(lines, n).rlike(HAS_WORD))


def pairs(text: Column) -> Column:
    """Each line with a word up to the next such line, as an array of arrays of lines."""

    def cut(lines: Column, at: Column) -> Column:
        ends = F.arrays_zip(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))).alias("a"), F.slice(at, 2, F.size(at)).alias("b"))
        return F.transform(ends, lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1))

    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.struct(ls.alias("l"), _worded_places(ls).alias("at")))
    return F.get(F.transform(bound, lambda s: cut(s["l"], s["at"])), 0)


def _without_pairs(text: Column, places: Column) -> Column:
    """The text's lines that are in none of the pairs at ``places``."""

    def left(lines: Column, at: Column) -> Column:
        gone = F.flatten(F.transform(places, lambda p: F.sequence(F.get(at, p), F.get(at, p + 1))))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda n: F.get(lines, n))

    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.struct(ls.alias("l"), _worded_places(ls).alias("at")))
    return F.get(F.transform(bound, lambda s: left(s["l"], s["at"])), 0)


def _worded(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD)))


def _marks(docs: DataFrame, parts: Callable[[Column], Column]) -> DataFrame:
    """(key_a, key_b, marks): the chunks of each row of ``docs`` whose hash repeats, with their place and whether they are the first."""
    rows = docs.filter("text is not null").select("doc_id", *text_key("doc_id", "text"), parts(F.col("text")).alias("chunks"))
    one = rows.select("doc_id", *KEYS, F.posexplode("chunks").alias("place", "lines"))
    one = one.filter(F.size("lines") >= MIN_LINES).filter(_worded(F.col("lines")) >= MIN_LINES)
    body = F.array_join("lines", "\n")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS, "place").alias("at")
    slim = store(one.select(F.xxhash64(body).alias("h"), F.xxhash64(F.lit(7), body).alias("g"), order), "chunks")
    # Rows that are equal have the same places.
    again = slim.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first != last")
    mark = F.struct("at.place", "h", "g", (F.col("at") == F.col("first")).alias("first"))
    found = slim.join(again.select("h", "g", "first"), ["h", "g"])
    return found.groupBy("at.key_a", "at.key_b").agg(F.collect_set(mark).alias("marks"))


def _repeated(marked: DataFrame, parts: Callable[[Column], Column]) -> DataFrame:
    """(key_a, key_b, places): the chunks that have the same bytes as the first of their hash."""
    own = marked.filter("marks is not null").select(*KEYS, "marks", parts(F.col("row.text")).alias("chunks"))

    def with_chunk(mark: Column) -> Column:
        chunk = F.array_join(F.get("chunks", mark["place"]), "\n")
        return F.struct(*(mark[c].alias(c) for c in ("place", "h", "g", "first")), chunk.alias("chunk"))

    # Each mark takes its own chunk along, and not the whole text.
    one = own.select(*KEYS, F.inline(F.transform("marks", with_chunk)))
    first = one.filter("first").select("h", "g", F.col("chunk").alias("first_chunk")).dropDuplicates(["h", "g"])
    later = one.filter("not first").select("h", "g", *KEYS, "place", "chunk").join(first, ["h", "g"])
    return later.filter("chunk = first_chunk").groupBy(*KEYS).agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` as a column ``row``, with ``kept`` (the text left), ``n_lines`` and ``n_removed``.

    ``kept`` joins the lines that stay by line feeds; it is '' if none stay. A
    null text stays null with 0 lines; an empty one has one empty line. Rows
    equal in doc_id and text count as one document and keep the same lines;
    rows that tie in doc_id only are told apart by a hash of the text; null
    doc_ids come last. An empty table gives an empty result. All columns are
    carried in ``row``, whatever their names. With ``whole``, pairs of lines
    are compared instead of chunks, so nothing of a repeated passage stays.
    """
    parts = pairs if whole else chunks
    rows = docs.select(F.struct("*").alias("row"), *text_key("doc_id", "text"))
    marked = rows.join(_marks(docs, parts), KEYS, "left")
    # Both sides are dealt out by the key already, so this join moves no texts.
    joined = marked.join(_repeated(marked, parts), KEYS, "left").withColumn("text", F.col("row.text"))
    touched = F.col("places").isNotNull()
    if whole:
        cut, lines = joined, F.when(touched, _without_pairs(F.col("text"), F.col("places")))
    else:
        split = F.when(touched, chunks(F.col("text")))
        cut = joined.withColumn("split", split)
        stays = F.filter(F.col("split"), lambda c, i: ~F.array_contains(F.col("places"), i))
        lines = F.when(touched, F.flatten(stays))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return cut.withColumn("lines", lines).select(
        "row",
        F.when(touched, F.array_join("lines", "\n")).otherwise(F.col("text")).alias("kept"),
        total.cast("long").alias("n_lines"),
        F.when(touched, total - F.size("lines")).otherwise(0).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` without the repeated chunks (pairs with ``whole``), with ``n_chars`` made anew; documents left without a word go.

    A document that had no word to begin with stays as it is.
    """
    found = dedup_lines(docs, whole)
    stays = (F.col("n_removed") == 0) | F.col("kept").rlike(HAS_WORD)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"])
    values = {"text": F.col("kept"), "n_chars": chars}
    return found.filter(stays).select([values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
