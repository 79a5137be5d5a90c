"""Helpers the operators share: tables, Arrow kernels, and splitting of hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of every text contract (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kernel(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` on every Arrow batch; rows are independent of each other."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(over, schema)


def raw(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups out of batches sorted by `keys`: a table with the starts and ends of
    its groups.  No more than a batch and one group is held."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.flatnonzero(change) + 1
        if len(starts):
            last = int(starts[-1])
            yield t.slice(0, last).combine_chunks(), np.r_[0, starts[:-1]], starts
            t = t.slice(last)
        rest = t
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0]), np.array([rest.num_rows])


def cells(members: DataFrame, keys: list[str], node: str, block: int, useful: Column | None = None) -> DataFrame:
    """Deal the members of every group to cells of two blocks each, so that every pair of
    members meets in exactly one cell and no cell has many more than 2 * `block` rows.

    Groups of one member, and groups without a row that `useful` counts, are left out.
    Adds `own_block`, `cell_a`, `cell_b`; pairs of one block meet where cell_a = cell_b."""
    want = [F.count(F.lit(1)).alias("_n"), F.max(F.lit(True) if useful is None else useful).alias("_ok")]
    sizes = members.groupBy(*keys).agg(*want).where("_n > 1 and _ok").drop("_ok")
    parts = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), F.col("_parts").cast("long")).cast("int")
    return (members.join(sizes, keys).withColumn("_parts", parts).withColumn("own_block", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .withColumn("cell_a", F.least("own_block", "_other")).withColumn("cell_b", F.greatest("own_block", "_other"))
            .drop("_n", "_parts", "_other"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what a-b connects."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
        if np.array_equal(low, before):
            break
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]
