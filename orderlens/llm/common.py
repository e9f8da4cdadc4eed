"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; the same pattern serves Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"

# Rows are taken from an Arrow batch in slices of about this many bytes.
SLICE_BYTES = 8 * 1024 * 1024

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that together identify a row by the given columns.

    Rows that are equal in all of them share the key; operators treat such
    rows as copies of one another.
    """
    ahead = [F.col(c) for c in columns]
    marks = [F.col(c).isNull() for c in columns]
    return [
        F.xxhash64(*ahead, *marks).alias("key_a"),
        F.xxhash64(F.lit(7), *reversed(ahead), *marks).alias("key_b"),
    ]


def row_dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The batches' rows as dictionaries, a bounded slice at a time."""
    for batch in batches:
        step = max(1, min(1024, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield from batch.slice(start, step).to_pylist()


def map_rows(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``work`` over each partition's rows as dictionaries, a bounded slice at a time.

    ``work`` gets an iterator over the rows of a partition and yields result
    rows; neither side is ever held whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in work(row_dicts(batches)):
            held.append(row)
            size += 64 + sum(len(v) for v in row.values() if isinstance(v, (str, bytes, list)))
            if size >= SLICE_BYTES or len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, kind)
