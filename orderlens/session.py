"""Session settings and the shared folder for stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def local_session(name: str = "orderlens", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may leave the setting out; it then gets a
    scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-orderlens-")
    return _local_folders[context.applicationId]


_scopes: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path under the shared folder, in the innermost ``scope`` if there is one."""
    app = spark.sparkContext.applicationId
    return "/".join([shared_folder(spark), "orderlens", app, *_scopes, f"{label}-{uuid.uuid4().hex}"])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored within when the scope ends; results must have been used by then.

    Order and catalog tables that are kept for the application are best built
    before.
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = fresh_path(spark, "x").rpartition("/")[0]
    try:
        yield
    finally:
        _scopes.pop()
        discard(spark, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table or folder; nothing may read it any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def store_only(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``build`` returns as a stored table, and its path; all that was stored on the way is removed."""
    path = fresh_path(spark, label)
    with scope(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are removed as soon as it has ended, and not when the driver collects garbage.

    For jobs made of stored steps, whose frames run once.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs only the tasks
    it was running, never the whole lineage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
