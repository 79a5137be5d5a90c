"""Quality rules: base counts of a text, and cross-document line frequency per host."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut
from .common import kernel, raw

_SYMBOL = re.compile(rb"[#*$%&|<>]")

#: Length in words of the windows whose repeats are counted, and the base limits (fixed values of the contract).
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a `window`-word window that is found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):  # a polynomial of 64-bit word hashes
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def normalised(line: bytes) -> bytes:
    """What lines are compared by: ASCII lower case, words joined by one space."""
    return b" ".join(line.lower().split())


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


COUNTS = [x.split()[0] for x in BASE.split(", ")]


def _name(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - 2 ** 63


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: list[list[int]] = [[], [], [], [], []]
    lines: list[list[dict]] = []
    prints = []
    for text in raw(batch.column("text")):
        words = text.split()
        joined = b"".join(words)
        for column, value in zip(counts, (len(words), len(joined.decode("utf-8", "surrogatepass")), len(_SYMBOL.findall(text)),
                                          duplicate_lines(text), repeated_words(words))):
            column.append(value)
        own: dict[bytes, int] = {}
        whole = [line for line in map(normalised, text.split(b"\n")) if line]
        for line in whole:
            own[line] = own.get(line, 0) + line.count(b" ") + 1
        prints.append(_name(b"\n".join(whole)))
        lines.append([{"line": _name(k), "words": v} for k, v in own.items()])
    columns = [batch.column("row"), batch.column("host"), *(pa.array(c, pa.int64()) for c in counts),
               pa.array(prints, pa.int64()), pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
    return pa.RecordBatch.from_arrays(columns, ["row", "host", *COUNTS, "print", "lines"])


#: A line is common on a host if more of its documents hold it than this share of them in percent, and than MOST.
SHARE_PERCENT, MOST = 2, 10


def quality(docs: DataFrame, max_documents: int = MOST, min_left_percent: int = 20, key: str = "doc_id", text: str = "text",
            host: str = "source", share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(key, the base counts, base_failed, n_common_words, kept): one row per document.

    Documents of a host are distinct if their whole normalised texts are; copies count once.
    A line is common if, normalised, more than `max_documents` distinct documents of the
    host hold it, and more than `share_percent` % of them: beyond a small host, verdicts
    don't depend on the size of the table.  A document is rejected if it fails the base
    rules, or if less than `min_left_percent` % of its words are outside common lines; but
    near copies do not vanish as a group: of the documents that the same set of common lines
    leaves with too little, those of the smallest key (null last) are kept.
    Null texts have no words (base_failed); a null host is a host of its own; rows of
    one key are judged one by one; an empty table gives an empty table."""
    measured = _measured(docs, key, text, host)
    judged = cut(_verdicts(measured, _common(measured, max_documents, share_percent), min_left_percent)
                 .withColumn("set", F.when(~F.col("kept") & ~F.col("base_failed"), F.xxhash64(F.array_sort("common")))).drop("common"), "judged")
    least = F.min(F.struct(F.col("row.key").isNull(), F.col("row.key").alias("key")))
    spared = judged.where("set is not null").groupBy("host", "set").agg(least.alias("least")).select("host", "set", F.col("least.key").alias("_spared"))
    depleted = judged.where("set is not null").join(spared, ["host", "set"]).withColumn("kept", F.col("row.key").eqNullSafe(F.col("_spared")))
    rows = judged.where("set is null").unionByName(depleted.select(*judged.columns))  # the others need no join, which would gather them by host
    return rows.select(F.col("row.key").alias(key), *COUNTS, "base_failed", "n_common_words", "kept")


def _verdicts(measured: DataFrame, common: DataFrame, min_left_percent: int) -> DataFrame:
    lost = (_lines(measured).join(common, ["host", "line"]).groupBy("row")
            .agg(F.sum("words").alias("n_common_words"), F.collect_list("line").alias("common")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = 100 * (F.col("n_words") - F.col("n_common_words")) >= min_left_percent * F.col("n_words")
    return (measured.select("row", "host", *COUNTS).join(lost, "row", "left")
            .withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)))
            .withColumn("base_failed", failed).withColumn("kept", ~failed & verdict))


def _measured(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Counts and lines of every row, written once.  `row` tells rows of one key apart; it
    is set before the kernel and read back from the written table only."""
    row = F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("n"))
    rows = docs.select(row.alias("row"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return cut(kernel(rows, _measure, f"row {kind}, host string, {BASE}, print long, lines array<struct<line: long, words: long>>"), "measured")


def _lines(measured: DataFrame) -> DataFrame:
    return measured.select("row", "host", "print", F.explode("lines").alias("l")).select("row", "host", "print", "l.*")


def _common(measured: DataFrame, max_documents: int, share_percent: int) -> DataFrame:
    """(host, line) of the common lines.  Equal (host, line, document) rows are merged before the
    shuffle, then counts are summed."""
    hosts = (measured.groupBy("host", "print").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("n_host")))
    merged = _lines(measured).groupBy("host", "line", "print").agg(F.lit(1).alias("one"))
    often = merged.groupBy("host", "line").agg(F.sum("one").alias("n")).where(F.col("n") > max_documents)
    return often.join(hosts, "host").where(100 * F.col("n") > share_percent * F.col("n_host")).select("host", "line")


def clean(docs: DataFrame, max_documents: int = MOST, min_left_percent: int = 20, key: str = "doc_id", text: str = "text",
          host: str = "source", share_percent: int = SHARE_PERCENT) -> DataFrame:
    """The documents that pass the rules, without their common lines; all columns.

    Lines are common as in `quality`.  Of the documents of a host that the same set of
    common lines leaves with too little, that of the smallest key (null last) stays, whole:
    near copies do not vanish as a group.  A verdict depends on key, text and host alone,
    so equal rows all stay or all go.  Null texts fail the base rules and go; a null host is a
    host of its own; texts are read whole; an empty table gives an empty one."""
    row = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text"), F.xxhash64(F.col(host)).alias("host"))
    measured = _measured(docs.select(row.alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_host")), "_row", "_text", "_host")
    judged = cut(_verdicts(measured, _common(measured, max_documents, share_percent), min_left_percent)
                 .where("not base_failed").select("host", F.col("row.key").alias("row"), "common", "kept"), "judged")
    kept = judged.where("kept").groupBy("row").agg(F.first("common").alias("_common"))
    least = F.min(F.struct(F.col("row.key").isNull(), F.col("row").alias("row")))
    spared = (judged.where("not kept").groupBy("host", F.xxhash64(F.array_sort("common")).alias("common")).agg(least.alias("least"))
              .select("least.row", F.lit(None).cast("array<long>").alias("_common")))
    good = kept.unionByName(spared).select(F.col("row.key").alias("_key"), F.col("row.text").alias("_t"), F.col("row.host").alias("_h"), "_common")
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(text)) == F.col("_t")) & (F.xxhash64(F.col(host)) == F.col("_h"))
    kept = docs.join(good, on).drop("_key", "_t", "_h")

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for content, common in zip(raw(batch.column(text)), batch.column("_common").to_pylist()):
            if common:
                gone = set(common)
                content = b"\n".join(x for x in content.split(b"\n") if _name(normalised(x)) not in gone)
            texts.append(content)
        names = [n for n in batch.schema.names if n != "_common"]
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == text else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names)

    return kernel(kept, strip, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
