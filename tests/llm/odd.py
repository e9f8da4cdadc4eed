"""Small tables with every oddity: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

PASSAGE = " ".join(f"passage{n}" for n in range(60))
LONG = " ".join(f"w{n * 7919 % 10007}" for n in range(30_000))

DOC_ROWS = [
    (1, "", "en", "b", 0),
    (2, None, None, "a", None),
    (3, "one two\nthree four\nfive six\nseven eight\nnine ten\neleven", "en", None, 50),
    (3, "one two\nthree four\nfive six\nseven eight\nnine ten\neleven", "en", None, 50),
    (4, "one two\nthree four\nfive six\nseven eight\nnine ten\neleven", "en", "a", 50),
    (4, "another text with the same id", "en", "a", 29),
    (None, "no id here, but some words all the same", "de", "b", 39),
    (None, None, None, None, None),
    (5, " \t\n\x0b\x0c\r ", "fr", "b", 7),
    (6, f"before {PASSAGE} after it", "en", "é", 10),
    (7, f"some other start {PASSAGE} and its own end", "en", "\U0001f600", 10),
    (8, LONG, "en", "a", len(LONG)),
    (9, "x" * 5000, "en", "c", 5000),
    (10, "éè \U0001f600 한국어 " * 40, "ko", "c", 1),
    (11, "\n".join(["same line again"] * 12), "en", "c", 1),
    (12, "Word " * 12 + "#*$%&|<>" * 9, "en", "c", 1),
]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Names that operators use for columns of their own.
CLASHING = (
    "key_a key_b fp group component_id h pos marks places place row kept lines split chunk at item doc seed copies target "
    "size_ copy __part __at first shift score label toxic_ host path suffix prediction features digest first_id"
).split()


def documents(spark, rows=None):
    """The odd documents, with clashing columns beside the usual ones."""
    rows = DOC_ROWS if rows is None else rows
    schema = DOC_SCHEMA + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], schema)


HTML = "<html><body><nav>menu</nav><article><p>" + "good text, " * 20 + "</p></article></body></html>"
PAGE_ROWS = [
    (1, "http://A.example.net/en/x?y=1#z", HTML),
    (2, None, HTML),
    (3, "no scheme", ""),
    (4, "https://example.com/de/1", None),
    (4, "https://example.com/de/1", None),
    (None, "ftp://x.org/fr/\r\n%41", HTML),
    (None, "", "short"),
    (5, "http://net", "<p>" * 3000 + "deep"),
    (6, "http://badexample.net/en/", "\U0001f600 " * 20_000),
    (1, "http://again.org/fr/", HTML),
]
PAGE_SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows=None):
    rows = PAGE_ROWS if rows is None else rows
    schema = PAGE_SCHEMA + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], schema)


def random_text(pick: random.Random, n: int, letters: str = "ab") -> str:
    return "".join(pick.choice(letters) for _ in range(n))
