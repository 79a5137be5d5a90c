"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and
names the nearest of the 2d signed axes; a bucket joins several hashes, there are several
tables of them.  A vector lies in its own bucket of every table, and is also shown in the
buckets its second-best axes name (multiprobe).  Two vectors are candidates if one lies
in a bucket where the other is shown; every candidate is verified by its exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut
from .common import cells, forest, runs
from .components import components


@dataclass(frozen=True)
class CrossPolytope:
    """Hash family.  `tables` buckets of `hashes` axes each; 2 ** hashes probes a table."""

    tables: int = 6
    hashes: int = 3
    seed: int = 7

    @property
    def probes(self) -> int:
        return 2 ** self.hashes

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, probes) bucket numbers of unit vectors; probe 0 is the own bucket."""
        n, dims = unit.shape
        size = max(2, 1 << (dims - 1).bit_length())
        rng = np.random.default_rng(self.seed + dims)
        out = np.empty((n, self.tables, self.probes), np.int64)
        for t in range(self.tables):
            axes = np.empty((n, self.hashes, 2), np.int64)
            for h in range(self.hashes):
                y = np.zeros((n, size))
                y[:, :dims] = unit
                for _ in range(3):
                    y = hadamard(y * rng.choice([-1.0, 1.0], size))
                mag = np.abs(y)
                first = mag.argmax(axis=1)
                mag[np.arange(n), first] = -1
                for k, axis in enumerate((first, mag.argmax(axis=1))):
                    axes[:, h, k] = 2 * axis + (y[np.arange(n), axis] < 0)
            for p, pick in enumerate(product((0, 1), repeat=self.hashes)):
                code = np.full(n, t, np.int64)
                for h, k in enumerate(pick):
                    code = code * (2 * size) + axes[:, h, k]
                out[:, t, p] = code
        return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (length a power of two), orthonormal."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def _vectors(column) -> np.ndarray:
    """Rows of a list column that all have one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, family: CrossPolytope = CrossPolytope(), block: int = 1024,
                    key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(key, n_links, component_id, kept): one row per vector.

    Linked are vectors of one label and one length, found by the index, of cosine
    >= `threshold`.  Null keys, labels or vectors, empty and zero vectors and such with
    null, NaN or infinite components link with nothing (n_links 0, component_id the own
    key).  Rows of one key are one node.  Equal vectors are one class with a count, so a
    large group of copies stays one row; an empty table gives an empty table."""
    rows = cut(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"),
                              (F.col(label).cast("string") if label else F.lit("")).alias("label")), "vectors")
    sound = ("key is not null and label is not null and size(vec) > 0 and exists(vec, x -> x <> 0) "
             "and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    classes = (rows.where(sound).groupBy("label", "vec").agg(F.min("key").alias("cls"), F.count(F.lit(1)).alias("copies"))
               .withColumn("dims", F.size("vec")).withColumn("node", F.xxhash64("label", "vec")))
    classes = cut(_hashed(classes, family), "classes")
    # Only bucket numbers travel until a bucket is known to hold a pair.
    shown = (classes.select("node", "label", "dims", F.posexplode("codes").alias("at", "bucket"))
             .withColumn("own", F.col("at") % family.probes == 0).drop("at"))
    where = ["label", "dims", "bucket", "cell_a", "cell_b"]
    dealt = (cells(shown, ["label", "dims", "bucket"], "node", block, useful=F.col("own"))
             .join(classes.select("node", "label", "dims", "cls", "copies", "vec", "codes"), ["node", "label", "dims"])
             .withColumn("lab", F.xxhash64("label")))
    order = ["lab", *where[1:]]
    met = cut(dealt.repartition(*order).sortWithinPartitions(*order)
              .select(*order, "own_block", "own", "cls", "copies", "vec", "codes")
              .mapInArrow(_verify(order, threshold, family), "a long, b long, n long"), "met")

    links = met.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    group = components(met.where("b is not null"))
    of_class = (classes.select("label", "vec", "cls", "copies")
                .join(links.withColumnRenamed("a", "cls"), "cls", "left")
                .join(group.withColumnRenamed("node", "cls"), "cls", "left")
                .select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "cls").alias("component")))
    ok = F.expr(sound)
    joined = (rows.where(ok).join(of_class, ["label", "vec"]).select("key", "n_links", "component")
              .unionByName(rows.where(~F.coalesce(ok, F.lit(False))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))))
    return joined.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"),
                         F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def _hashed(classes: DataFrame, family: CrossPolytope) -> DataFrame:
    """The classes with the bucket numbers of all tables and probes, in this order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                codes = family.buckets(_unit(_vectors(part.column("vec"))))
                yield part.append_column(pa.field("codes", pa.list_(pa.int64())), pa.array(list(codes.reshape(len(codes), -1)), pa.list_(pa.int64())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(work, f"{schema}, codes array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verify(order: list[str], threshold: float, family: CrossPolytope):
    """Kernel over cells: (class, null, links found here first) and forest edges (a, b, 0).

    A pair that meets in several buckets counts in the smallest of them only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, order):
            cls, copies = t["cls"].to_numpy(), t["copies"].to_numpy()
            own, blk, bucket = t["own"].to_numpy(zero_copy_only=False), t["own_block"].to_numpy(), t["bucket"].to_numpy()
            cross = t["cell_a"].to_numpy() != t["cell_b"].to_numpy()
            out_a, out_b, out_n = [], [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s < 2 or not own[s:e].any() or (cross[s] and len(np.unique(blk[s:e])) < 2):
                    continue
                x = _unit(_vectors(t["vec"].slice(s, e - s)))
                i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                ok = own[s:e][i] | own[s:e][j]
                if cross[s]:
                    ok &= blk[s:e][i] != blk[s:e][j]
                ok &= cls[s:e][i] != cls[s:e][j]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                codes = t["codes"].slice(s, e - s).combine_chunks().flatten().to_numpy().reshape(e - s, family.tables, family.probes)
                first = np.concatenate([_first_bucket(codes, i[k:k + 65536], j[k:k + 65536]) for k in range(0, len(i), 65536)]) == bucket[s]
                i, j = i[first], j[first]
                n = np.zeros(e - s, np.int64)
                np.add.at(n, i, copies[s:e][j])
                np.add.at(n, j, copies[s:e][i])
                some = np.flatnonzero(n)
                a, b = forest(cls[s:e][i], cls[s:e][j])
                out_a += [cls[s:e][some], a]
                out_b += [np.full(len(some), -1), b]
                out_n += [n[some], np.zeros(len(a), np.int64)]
            if out_a:
                n = np.concatenate(out_n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()),
                                                  pa.array(np.concatenate(out_b), pa.int64(), mask=n > 0), pa.array(n)], ["a", "b", "n"])

    return work


def _first_bucket(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest bucket in which each pair i, j meets, one of them in its own."""
    a, b = codes[i], codes[j]
    big = np.iinfo(np.int64).max
    mine = np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], big).min(axis=1)
    other = np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], big).min(axis=1)
    return np.minimum(mine, other)
