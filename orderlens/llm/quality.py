"""Quality rules as a short-circuit cascade.

Rules are predicates on one text that say "reject". On a sample of texts each
rule's cost (seconds per text) and selectivity (share it rejects) are
measured; rules then run in the order of rejections per second, and a text's
first rejection ends its cascade. The order never changes which texts are
kept, only how soon the others are given up.

The sample has an expected size (``SAMPLE_ROWS``); the measurements run where
the rows are and come back as one row per rule and task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import map_rows

SAMPLE_ROWS = 1000
SAMPLE_SEED = 11

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
MAX_DOUBLED_PERCENT = 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 15

SYMBOLS = re.compile(r"[#*$%&|<>]")
WHITE = " \t\n\x0b\x0c\r"
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


class Measures:
    """What the rules look at, computed from a text on first use."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return [w for w in _SPACES.split(self.text) if w]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five words that occur twice or more, the first included."""
        n = self.n_words - WINDOW_WORDS + 1
        if n < 2:
            return 0
        numbers: dict[str, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in self.words], dtype=np.int64)
        count = len(ids) + 1
        pairs = _ranks(ids[:-1] * count + ids[1:])
        fours = _ranks(pairs[:-2] * count + pairs[2:])
        windows = fours[: n] * count + ids[WINDOW_WORDS - 1 :]
        _, inverse, seen = np.unique(windows, return_inverse=True, return_counts=True)
        if len(seen) == n:
            return 0
        covered = np.zeros(self.n_words + 1, dtype=np.int64)
        starts = np.nonzero(seen[inverse] > 1)[0]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW_WORDS, -1)
        return int((np.cumsum(covered) > 0).sum())

    @cached_property
    def n_doubled_words(self) -> int:
        """Words that equal the word before them."""
        return sum(map(eq, self.words, self.words[1:]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
)
MORE_RULES = (
    Rule("symbols", lambda m: 100 * m.n_symbols > MAX_SYMBOL_PERCENT * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > MAX_DUP_LINE_PERCENT * len(m.lines)),
    Rule("doubled_words", lambda m: 100 * m.n_doubled_words > MAX_DOUBLED_PERCENT * m.n_words),
    Rule("short_words", lambda m: m.word_chars < MIN_WORD_CHARS * m.n_words),
    Rule("long_words", lambda m: m.word_chars > MAX_WORD_CHARS * m.n_words),
)
RULES = BASE_RULES + MORE_RULES


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of ``docs``; those that never reject come last, cheapest first."""
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, rows / max(1, total)), seed=SAMPLE_SEED)

    def measure(texts: Iterator[dict]) -> Iterator[dict]:
        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for row in texts:
            seen += 1
            for k, rule in enumerate(rules):
                start = time.perf_counter()
                rejected[k] += bool(rule.rejects(Measures(row["text"])))
                spent[k] += time.perf_counter() - start
        for k in range(len(rules)):
            yield {"rule": k, "seconds": spent[k], "rejected": rejected[k], "seen": seen}

    parts = map_rows(sample, measure, "rule int, seconds double, rejected bigint, seen bigint")
    found = parts.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    worth = {x["rule"]: (-x["r"] / max(x["s"], 1e-9), x["s"]) for x in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (worth.get(k, (0.0, 0.0)), k))]


def first_rejection(measures: Measures, rules: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(measures)), None)


def measure_and_judge(docs: DataFrame, rules: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base measures, base_failed, rejected_by, kept.

    Texts that pass the base rules go through the cascade of ``rules``;
    ``rejected_by`` is the first rule that rejected (null for base failures).
    Null and empty texts have no words and fail the base rule. Repeated rows
    are judged alike; a null doc_id is kept as it is; an empty table gives an
    empty result. Other columns are ignored. Texts may have any length; one at a
    time is held, with its words.
    """
    cascade = ordered(docs, rules)

    def judge(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            m = Measures(row["text"])
            failed = first_rejection(m, BASE_RULES) is not None
            by = None if failed else first_rejection(m, cascade)
            yield {
                "doc_id": row["doc_id"],
                "n_words": m.n_words,
                "word_chars": m.word_chars,
                "n_symbols": m.n_symbols,
                "n_dup_lines": m.n_dup_lines,
                "n_repeat_words": m.n_repeat_words,
                "base_failed": failed,
                "rejected_by": by,
                "kept": not failed and by is None,
            }

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, rejected_by string, kept boolean"
    )
    return map_rows(docs.select("doc_id", "text"), judge, schema)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    cascade = ordered(docs, rules)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")
            kept = [first_rejection(Measures(t.as_py()), cascade) is None for t in texts]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
