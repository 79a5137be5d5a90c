"""Mixing sources to target weights.

Targets are shared out by water-filling over the source totals.  Inside a source,
documents are ordered by a hash-random key; the key's range is cut into equal stretches
of about `stretch` documents, stretch totals are summed up per source and documents
inside their stretch, which together is the prefix sum of sizes over the whole source
without a task that holds more than a stretch.  Whole epochs come first, and the last
one is cut at the exact word where the source's budget ends.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.shared import cut
from .common import WORD, kernel, raw

#: Weights by rank of the source, repeating (fixed values of the contract).
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2) -> DataFrame:
    """(source, documents, source_size, target) from (source, documents, source_size).

    Sources by code point, null last, get the repeating weights and share
    `share_percent` % of all sizes; a target stops at `most` times its source's size and
    the excess goes to the others by weight.  That is a water level: by falling
    size / weight, sources are full as long as the level of what is left exceeds theirs.
    One row per source is all that is ordered here."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = (ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
              .withColumn("cap", F.col("source_size") * most))
    pool = F.sum("source_size").over(every) * share_percent
    level = (pool - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))) / (100 * F.sum("weight").over(rest))
    found = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.least(F.col("weight") * water, F.col("cap").cast("double"))
    return found.select("source", "documents", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, most: int = 2,
        stretch: int = 2_000, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, epochs, part, taken): one row per document.

    A document is taken `epochs` times whole and once more with its first `part` words;
    taken = epochs * size + part, so a source's words sum up to its rounded-down target.
    The random key is the MD5 of seed and document key: reruns agree.  Null texts have
    size 0, null sources are a source of their own, rows of one key (or without one) are
    neighbours in the order, and equal rows among them may swap what they take."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), (word_count(F.col(text)) if size is None else size).alias("size"))
    rows = cut(rows.withColumn("random", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("key").cast("string"), F.lit(""))))), "sizes")
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, share_percent, most), "targets")
    share = F.conv(F.substring("random", 1, 13), 16, 10).cast("double") / float(16 ** 13)
    on = F.expr("s <=> source")
    placed = (rows.join(targets.withColumnRenamed("source", "s"), on).drop("s")
              .withColumn("stretch", F.floor(share * F.ceil(F.col("documents") / stretch)).cast("long")))
    sums = placed.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("stretch").alias("t"), start.alias("start"))
    inside = Window.partitionBy("source", "stretch").orderBy("random", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.floor(F.col("target") / F.col("source_size"))
    left = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    return (placed.join(starts, F.expr("s <=> source and t = stretch")).withColumn("before", before)
            .withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("long"))
            .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before"))).cast("long"))
            .select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "epochs", "part",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    end = 0
    for k, found in enumerate(_WORD.finditer(text), 1):
        end = found.end()
        if k == n:
            break
    return text[:end] if n else b""


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself: a row for every time a document is taken, cut after `part` words the
    last time; all columns.  Rows equal in key, source and text are one document, and each
    of them is taken as often as it is."""
    same = {"_mix_key": F.col(key), "_mix_source": F.col(source), "_mix_hash": F.xxhash64(F.col(text))}
    marked = docs.withColumns(same | {"_mix_size": word_count(F.col(text))})
    ids = cut(marked.select(*same, "_mix_size").distinct().withColumn("_mix_id", F.struct(*same)), "ids")
    taken = mix(ids, F.col("_mix_size"), key="_mix_id", source="_mix_source", text="_mix_id", **how)
    taken = taken.where("taken > 0").select(F.col("_mix_id").alias("_t"), "epochs", "part", "size")
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int"))
    last = F.when(F.col("part") == F.col("size"), F.array(F.lit(-1).cast("long"))).when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))
    taken = taken.select("_t", F.explode(F.concat(whole, last)).alias("_mix_take"))
    on = F.expr("_mix_key <=> _t._mix_key and _mix_source <=> _t._mix_source and _mix_hash = _t._mix_hash")
    rows = marked.join(taken, on).select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_take")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        take = batch.column("_mix_take").to_pylist()
        texts = [t if n < 0 else first_words(t, n) for t, n in zip(raw(batch.column(text)), take)]
        names = [c for c in batch.schema.names if c != "_mix_take"]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in names], names)

    return kernel(rows, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
