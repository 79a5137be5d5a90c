"""Files that appear whole or not at all: write aside, then publish by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, base: str, name: str, write: Callable[[str], None]) -> str:
    """Let `write` fill a folder aside and rename it to `base`/`name`.

    A run that fails leaves what was published before as it was.  The rename is refused if the
    name is taken, so of two runs at once one wins and the other raises.
    """
    aside = f"{base}/_aside-{uuid.uuid4().hex}"
    write(aside)
    source, fs = _fs(spark, aside)
    target, _ = _fs(spark, f"{base}/{name}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise RuntimeError(f"{base}/{name} has been published by another run")
    return f"{base}/{name}"


def published(spark: SparkSession, base: str, prefix: str) -> str | None:
    """The last folder that was published below `base` under a name with the prefix."""
    names = [n for n in children(spark, base) if n.startswith(prefix)]
    return f"{base}/{names[-1]}" if names else None
