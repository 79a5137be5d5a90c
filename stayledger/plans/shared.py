"""Shared intermediate tables.

A reconciliation uses some relations several times (stay classes, name scores, matches).
Writing them once keeps every plan small, spares the inputs further scans, and survives
the loss of executors, because the files live in the cluster's shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Paths of the tables cut inside the innermost `once`.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Spark 4.1 and later: an execution's shuffle files go when it ends; others keep them until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run_folder(spark: SparkSession) -> str:
    """Folder for this session's tables: below `spark.checkpoint.dir`, which a cluster
    must name; only a local session may fall back to a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            base = tempfile.mkdtemp(prefix="stayledger-")
        _FOLDERS[app] = f"{base.rstrip('/')}/stayledger-{app}"
    return _FOLDERS[app]


def discard(spark: SparkSession) -> None:
    """Delete the session's tables, in whatever store the folder is."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: what they have written is never evaluated again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str, split_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder, in a folder per value of `split_by`, and go on from the written table."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.partitionBy(*(split_by or [])).option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def once(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Cut what `make` returns, and delete the tables that were cut on the way to it."""
    outer = _MADE.set(made := [])
    try:
        df = make()
    finally:
        _MADE.reset(outer)
    out = cut(df, label)
    for path in made:
        _delete(df.sparkSession, path)
    return out
