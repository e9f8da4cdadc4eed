"""Searching a frame for many terms without a scan a term.

Every text that a cell of the frame shows is indexed once by its trigrams,
whatever the number of cells that show it. A search asks which trigrams a match
must hold: those of a literal, or those that a regular expression's literal
parts require. Texts that hold them are candidates, the search itself decides
on these alone, and the rows that show a text which matches are the result. A
term that requires no trigram, such as ``a.c``, is searched by a scan.

Letters are folded so that no match is lost to upper and lower case: two that a
search takes for one another are one in the index.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from orderlens.functions.values import kinds, text_form
from orderlens.operators.frames import check_pattern, holds, search
from orderlens.session import store

GRAM = 3
# Trigrams of one literal that are asked for; the first ones do, as every candidate is searched in the end.
ASKED = 32

TEXT = ["a", "b"]

# Letters that upper and lower case do not bring together, in upper and in lower case.
UPPER_ALIKE = (("\u0130", "I"),)
LOWER_ALIKE = (("\u03c2", "\u03c3"), ("\u00df", "ss"))


def fold(text: Column) -> Column:
    """Letters that differ in case alone as one, also where upper and lower case have no single letter for it."""
    def replaced(letters: Column, pairs: Sequence[tuple[str, str]]) -> Column:
        return reduce(lambda t, pair: F.replace(t, *map(F.lit, pair)), pairs, letters)

    # Without something in between, the optimizer takes the lower case of the upper case for the lower case.
    return replaced(F.lower(replaced(F.upper(text), UPPER_ALIKE)), LOWER_ALIKE)


def folded(text: str) -> str:
    for old, new in UPPER_ALIKE:
        text = text.upper().replace(old, new)
    text = text.lower()
    for old, new in LOWER_ALIKE:
        text = text.replace(old, new)
    return text


@dataclass(frozen=True)
class Need:
    """What a match must hold: all of some trigrams, and for each of some choices one of its needs."""

    grams: frozenset[str] = frozenset()
    choices: tuple[tuple["Need", ...], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.grams or self.choices)

    def all_grams(self) -> set[str]:
        return set(self.grams).union(*(need.all_grams() for choice in self.choices for need in choice))

    def met(self, held: Column) -> Column:
        """Whether an array of trigrams is enough."""
        own = F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(self.grams))))) == len(self.grams)
        parts = [own] if self.grams else []
        parts += [reduce(or_, [need.met(held) for need in choice]) for choice in self.choices]
        return reduce(and_, parts)


def grams_of(literal: str) -> frozenset[str]:
    text = folded(literal)
    return frozenset(text[n : n + GRAM] for n in range(min(ASKED, len(text) - GRAM + 1)))


def needed(pattern: str) -> Need:
    """What every match of a regular expression holds; empty if nothing is known.

    The expression's parts come from Python's reader of regular expressions.
    What it does not know in the form that Spark takes needs nothing.
    """
    try:
        return _needed(parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError, OverflowError):
        return Need()


def _needed(parts: Sequence) -> Need:
    grams, choices, run = set(), [], ""
    for kind, value in [*parts, (None, None)]:
        if kind is parser.LITERAL:
            run += chr(value)
            continue
        grams |= grams_of(run)
        run = ""
        inner = None
        if kind is parser.SUBPATTERN:
            inner = _needed(value[3])
        elif kind is parser.ATOMIC_GROUP:
            inner = _needed(value)
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _needed(value[2])
        elif kind is parser.BRANCH:
            choice = tuple(_needed(part) for part in value[1])
            if all(choice):
                choices.append(choice)
        if inner:
            grams |= inner.grams
            choices += inner.choices
    return Need(frozenset(grams), tuple(choices))


@dataclass(frozen=True)
class SearchIndex:
    """A stored frame (columns numbered, ``row``), its texts, where they are shown, and their trigrams by the texts' numbers."""

    rows: DataFrame
    texts: DataFrame
    shown: DataFrame
    postings: DataFrame
    names: tuple[str, ...]

    def frame(self) -> DataFrame:
        return self.rows.drop("row").toDF(*self.names)

    def candidates(self, need: Need) -> DataFrame:
        """The texts (a, b, text) that hold what is needed."""
        some = self.postings.filter(F.col("gram").isin(sorted(need.all_grams())))
        # At most as many trigrams a text as are asked for.
        held = some.groupBy("number").agg(F.collect_set("gram").alias("held")).filter(need.met(F.col("held")))
        return self.texts.join(held.select("number"), "number", "left_semi").drop("number")

    def search(self, term: str, literal: bool = False) -> DataFrame:
        """The rows that ``frames.search`` finds."""
        need = Need(grams_of(term)) if literal else needed(term)
        if not literal and term:
            check_pattern(self.rows, term)
        if not need:
            return search(self.frame(), term, literal)
        texts = self.candidates(need).filter(holds(F.col("text"), term, literal)).select(*TEXT)
        rows = self.shown.join(texts, TEXT).select("row").distinct()
        return self.rows.join(rows, "row", "left_semi").drop("row").toDF(*self.names)


def search_index(df: DataFrame) -> SearchIndex:
    """The index of all columns of ``df``, stored.

    Texts are named by two 64-bit hashes, and by a number in the postings, which
    are many and where hashes could not be compressed. NULL is shown as no text.
    """
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    rows = store(numbered, "rows")
    # Columns of one type share one expression: written out for each of them, it makes code too long to be compiled.
    alike: dict[DataType, list[str]] = {}
    for name, kind in kinds(rows.drop("row")).items():
        alike.setdefault(kind, []).append(name)

    def shown_as(columns: list[str], kind: DataType) -> Column:
        # The function takes the value alone: a second parameter would be given its place.
        return F.transform(F.array(*columns), lambda x: text_form(x, kind))

    forms = [shown_as(columns, kind) for kind, columns in alike.items()]
    each = rows.select("row", F.explode(F.array_distinct(F.array_compact(F.concat(*forms)))).alias("text"))
    named = each.select("row", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"), "text")
    shown = store(named.select(*TEXT, "row"), "shown")
    unique = named.select(*TEXT, "text").dropDuplicates(TEXT)
    texts = store(unique.withColumn("number", F.monotonically_increasing_id()), "texts")
    body = F.transform(F.array(fold(F.col("text"))), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda n: F.substring(t, n, GRAM)))
    long = texts.filter(F.length(fold(F.col("text"))) >= GRAM)
    grams = long.select("number", F.explode(F.array_distinct(F.get(body, 0))).alias("gram"))
    # In order, so that a search reads only the files' parts that hold its trigrams.
    postings = store(grams.repartitionByRange("gram").sortWithinPartitions("gram", "number"), "postings")
    return SearchIndex(rows, texts, shown, postings, tuple(names))
