from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from orderlens.operators import frames
from orderlens.operators.search_index import Need, folded, grams_of, needed, search_index

ROWS = [
    (1, "High and Mighty", 12.5, None),
    (2, "\u00c9t\u00e9 \u00e0 la mer", 7.0, "stra\u00dfe STRASSE"),
    (3, "\u0130stanbul", None, "KELVIN \u212a \u017fum"),
    (4, None, None, None),
    (5, "", 1e20, "\u039f\u0394\u039f\u03a3 \u03bf\u03b4\u03bf\u03c2"),
    (5, "", 1e20, "\u039f\u0394\u039f\u03a3 \u03bf\u03b4\u03bf\u03c2"),
    (77, "a.c a+c abc aXc", 70.0, "line one\nline two"),
    (8, "x" * 500 + "needle" + "y" * 500, 0.1, "\U0001f600 emoji \U0001f600"),
]
TERMS = [
    "high", "HIGH AND", "and", "igh.*ty$", "^high", "a.c", "a\\.c", "(abc|axc)", "abc|zzz", "abc|z", "(?:need){1,2}le", "(need)?le", "need(le)*",
    "[nm]eedle", "\u00e9t\u00c9", "istan", "\u0130STAN", "kelvin k", "sum", "\u017fum", "stra\u00dfe", "strasse", "\u03bf\u03b4\u03bf\u03c3", "7\\.0$", "1\\.0E20", "70",
    "line.one", "(?s)one.line", "one\\nline", "emoji \U0001f600", "(?=needle)n", "(?!needle)x{400}", "\\bmer\\b", "\\Qa.c\\E", "\\p{Lu}igh", "(?x) hi gh", "nothing like it", "",
    "x{3}needle", "(high|mer)( and| la)?", "((high|(et|\u00e9t)\u00e9) (and|\u00e0 l))",
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, `a b` string, row double, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(frame):
    return search_index(frame)


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_scan(frame, index, term, literal):
    found = index.search(term, literal)
    assert found.columns == frame.columns
    assert rows_of(found) == rows_of(frames.search(frame, term, literal))


def test_invalid_patterns(index):
    with pytest.raises(frames.InvalidPattern):
        index.search("(abc")


def test_what_patterns_need():
    def grams(need: Need) -> set[str]:
        return need.all_grams()

    assert needed("High") == Need(grams_of("high")) and grams(needed("High")) == {"hig", "igh"}
    assert needed("abc.def").grams == {"abc", "def"}
    assert needed("(abc)+x?(def){2}").grams == {"abc", "def"}
    assert not needed("(abc)*") and not needed("ab.c") and not needed("abc|de") and not needed("[abc]{5}")
    either = needed("abc|x(def|ghi)")
    assert not either.grams and len(either.choices) == 1 and grams(either) == {"abc", "def", "ghi"}
    assert not needed("\\p{L}abc") and not needed("(abc")
    assert not needed("(?!abc)d") and not needed("(?=abc)a")
    assert len(grams_of("x" * 5 + "".join(map(chr, range(97, 123))) * 9)) <= 32
    assert folded("\u0130\u03a3\u1e9e") == "i\u03c3ss"


def test_candidates_are_few(spark):
    """Frequent texts are indexed once, and only those with the trigrams are searched."""
    df = spark.range(5000).select((F.col("id") % 50).alias("n"), F.concat(F.lit("text number "), F.col("id") % 100).alias("t"))
    found = search_index(df)
    assert found.texts.count() == 50 + 100
    assert found.candidates(needed("number 4[0-9]")).count() <= 100
    assert found.candidates(Need(grams_of("number 42"))).count() == 1
    assert found.search("number 42", True).count() == 50
    plan = found.postings.filter(F.col("gram").isin("abc"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), EqualTo(gram" in plan


def test_no_rows(spark):
    empty = search_index(spark.createDataFrame([], "a int, b string"))
    assert empty.search("abc").collect() == [] == empty.search("", True).collect()
    assert re.escape("x") == "x"


def test_postings_have_numbers_instead_of_hashes(index, frame):
    assert set(index.postings.columns) == {"number", "gram"}
    assert index.texts.select("number").distinct().count() == index.texts.count()
