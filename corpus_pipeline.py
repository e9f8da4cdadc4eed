"""The corpus pipeline: rules, line dedup, near-duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of documents; the last one also says which copy of a document a row
is. Stages are written as Parquet in between, in the shared folder, and read
again, so no stage depends on another's tasks.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, line_dedup, mixing, quality, simhash
from orderlens.llm.common import table
from orderlens.session import discard, store_only


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document has; those left without a word go."""
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for; ``copy`` counts from 1."""
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    return mixing.repeat_rows(mixing.mix(rows, carry=("row",))).select("row.*", "copy")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def whole_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of two or more worded lines that an earlier one has, so copies go or stay as they are."""
    return line_dedup.drop_repeated_lines(docs, whole=True)


def run(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """All stages over the table documents, each from the files of the one before; ``whole`` is for line dedup.

    What a stage stores on its way is removed when its result is written, and
    that when the next stage's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        if whole and stage is line_dedup_stage:
            stage = whole_line_dedup
        docs, path = store_only(spark, name, partial(stage, spark, docs, sf_dir))
        if before is not None:
            discard(spark, before)
        before = path
    return docs


# Fingerprints cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
