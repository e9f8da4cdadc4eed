"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become lower-case words of letters and digits. A document holds a leak of
an item if a window of 20 words of both, or of as many as the shorter one has
but 8 at least, agrees in at least 80 % of its places. This is one rule for all
sizes, and looks at no other item or document.

A mask such as ``1101100111`` lies over consecutive words and ignores those at
its zeros; the hash of the others is a seed. Seeds of all masks at all places
of documents and benchmark items are joined, so a passage is found although
words in it were replaced. Around every hit the two texts are laid side by side
and the windows that cover the hit are compared. The seven masks of ten words
find all windows of 10 words and more; where the document or the item has 8 or 9
words, three masks of eight do. Those are met only in such pairs, so that five
common words join no long texts.

Benchmark seeds are broadcast when they are counted and few; otherwise both
sides are shuffled by seed and hits are verified after a join by text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import text_key
from orderlens.session import store

# Whichever fifth of the 10 to 20 words of a window is replaced, one of these has none of them at its ones at some place.
MASKS = ("1101000011", "0010011101", "0110101010", "1001110100", "1011101000", "0100100111", "1111010000")
# One of these has none of 8 words at its ones, whichever word is replaced.
SHORT_MASKS = ("00011111", "11100011", "11111100")
# Items with fewer words are too short to tell a leak from chance.
MIN_WORDS = 8
WINDOW = 20
MIN_PERCENT = 80
# At most so many benchmark words are broadcast, as ten seeds each of 48 bytes.
BROADCAST_WORDS = 50_000

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, array: str, short: Column) -> DataFrame:
    """The seed of every mask at every place: the rows' columns, ``at`` (from 0), ``span`` and ``seed``.

    The short masks are laid where ``short`` holds.
    """
    least = min(map(len, SHORT_MASKS))
    # No filter on the size: it would be moved below and split every text once more.
    places = F.when(F.size(array) >= least, F.sequence(F.lit(0), F.size(array) - least))
    placed = rows.select("*", F.explode(places).alias("at"))

    def seed(mask: str) -> Column:
        picked = [F.get(F.col(array), F.col("at") + n) for n, c in enumerate(mask) if c == "1"]
        return F.struct(F.lit(len(mask)).alias("span"), F.xxhash64(F.lit(mask), *picked).alias("seed"))

    def seeds(masks: Sequence[str], where: Column) -> Column:
        return F.when(where, F.array(*map(seed, masks))).otherwise(F.array())

    fits = F.col("at") + len(MASKS[0]) <= F.size(array)
    each = F.concat(seeds(MASKS, fits), seeds(SHORT_MASKS, short))
    return placed.select("*", F.inline(each))


def _agrees(doc: Column, size: Column, item: Column, doc_at: Column, item_at: Column, window: int, percent: int) -> Column:
    """Whether some window that covers the hit has enough equal words.

    ``doc`` may be a part of the document's words around the hit, which is at
    ``doc_at`` in it; ``size`` counts all of them.
    """
    span = F.col("span")
    width = F.least(F.lit(window), size, F.size(item))
    shift = doc_at - item_at
    first = F.greatest(F.lit(0), item_at + span - width, -shift)
    last = F.least(item_at, F.size(item) - width, F.size(doc) - width - shift)

    def same(start: Column) -> Column:
        places = F.sequence(F.lit(0), width - 1)
        equal = F.filter(places, lambda n: F.get(doc, start + shift + n) == F.get(item, start + n))
        return F.size(equal) * 100 >= width * percent

    return (last >= first) & F.exists(F.sequence(first, F.greatest(first, last)), same)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    percent: int = MIN_PERCENT,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(doc_id, key_a, key_b, item_id): the items found in each contaminated document, each once.

    (key_a, key_b) names the document's row. Null and empty texts, on either
    side, match nothing, and items and documents under 8 words are passed over.
    Repeated documents count once; repeated items are all reported. Null ids
    are kept as they are. Empty tables give an empty result; other columns are
    ignored. Texts may have any length. ``percent`` under 80 may miss windows.
    """
    long = len(MASKS[0])
    items = store(
        benchmark.select("item_id", _hashed(F.col("text")).alias("item")).filter(F.size("item") >= MIN_WORDS), "items"
    )
    total = items.agg(F.sum(F.size("item"))).first()[0] or 0
    # Without short items, only short documents need the short masks.
    none_short = items.filter(F.size("item") < long).isEmpty()
    hashed = docs.select("doc_id", *text_key("doc_id", "text"), _hashed(F.col("text")).alias("doc"))
    places = _seeds(hashed, "doc", (F.size("doc") < long) if none_short else F.lit(True))
    places = places.withColumnsRenamed({"at": "doc_at", "span": "doc_span"}).withColumn("doc_short", F.size("doc") < long)
    numbered = store(items.distinct().withColumn("item_key", F.monotonically_increasing_id()), "items")
    sought = _seeds(numbered, "item", F.lit(True)).withColumnRenamed("at", "item_at")
    sought = sought.select("seed", "item_key", "item_at", "span", (F.size("item") < long).alias("item_short"))
    # A seed's hash covers its mask, so equal seeds have equal spans; short masks are for short texts.
    met = [places["seed"] == sought["seed"], (F.col("doc_span") == long) | F.col("doc_short") | F.col("item_short")]
    row = ["doc_id", "key_a", "key_b", "item_key"]
    if total <= broadcast_words:
        # Only the words around a hit go on with it.
        start = F.greatest(F.lit(0), F.col("doc_at") + F.col("span") - window)
        around = F.slice("doc", start + 1, F.col("doc_at") + window - start).alias("doc")
        hits = places.join(F.broadcast(sought), met).select(
            *row, (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at", "span", "doc_at", around,
            (F.col("doc_at") - start).alias("doc_place"), F.size("doc").alias("n_words"),
        )
        # A hit of several masks counts once.
        one = hits.groupBy(*row, "shift", "item_at", "span").agg(
            F.first("doc").alias("doc"), F.first("doc_place").alias("doc_place"), F.first("n_words").alias("n_words")
        )
    else:
        hits = places.drop("doc").join(sought, met)
        slim = hits.select(*row[1:], (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at", "span").distinct()
        whole = hashed.dropDuplicates(["key_a", "key_b"])
        one = slim.join(whole, ["key_a", "key_b"]).withColumns(
            {"doc_place": F.col("item_at") + F.col("shift"), "n_words": F.size("doc")}
        )
    agrees = _agrees(F.col("doc"), F.col("n_words"), F.col("item"), F.col("doc_place"), F.col("item_at"), window, percent)
    return one.join(numbered, "item_key").filter(agrees).select("doc_id", "key_a", "key_b", "item_id").distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    keys = ["key_a", "key_b"]
    found = leaks(docs, benchmark, **options).select(*keys).distinct()
    rows = docs.select(F.struct("*").alias("row"), *text_key("doc_id", "text"))
    return rows.join(found, keys, "left_anti").select("row.*")
