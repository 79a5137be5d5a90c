"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades 0 < 1 < ... < K share one weight vector and have ordered thresholds:
    P(grade > k) = sigmoid(w . x - threshold_k),  threshold_0 < threshold_1 < ...
x holds the square roots of the shares of a text's hashed byte trigrams, and hashed tokens
of the text's shape: how much it repeats words and lines, and its length.
The model gives every document its expected grade and the probability of the grades
from `pass_grade` on, by which documents are selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import kernel, raw


@dataclass(frozen=True)
class Fit:
    """`sample` bounds the labelled rows that are fitted on; they reach the driver as features."""

    sample: int = 6000
    bits: int = 12
    grades: int = 3
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - (x @ self.weights)[:, None]))


def features(text: bytes, bits: int) -> np.ndarray:
    """Square roots of trigram shares by hash, and a weight of 1/2 for each token of the
    text's shape; texts under three bytes are padded by zero bytes."""
    b = np.frombuffer(text.ljust(3, b"\0"), np.uint8).astype(np.uint32)
    packed = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    at = (packed * np.uint32(2654435761)) >> np.uint32(32 - bits)
    x = np.sqrt(np.bincount(at, minlength=1 << bits) / len(at))
    for token in shape_tokens(text):
        x[zlib.crc32(token) % (1 << bits)] += 0.5
    return x


def shape_tokens(text: bytes) -> list[bytes]:
    """Tenths of words that equal the one before, of distinct words and of repeated lines,
    and the logarithm of the number of words."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [b"same %d" % (10 * same // n), b"distinct %d" % (10 * len(set(words)) // n),
            b"lines %d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines))), b"length %d" % len(words).bit_length()]


def held_out(key: Column) -> Column:
    """One in five rows, by the CRC-32 of the key as text; never fitted on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade): 0 unfit, 1 fit but toxic, 2 fit; rows without key or quality are unrated."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).select(F.col(key).alias("key"), grade.alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, how: Fit = Fit(), key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most `how.sample` rated rows that aren't held out, picked by hash of key.

    The sample is bounded, so it is broadcast; the texts' features come back to the driver
    as `how.sample` rows of 2 ** bits numbers at most."""
    picked = ratings.where(~held_out(F.col("key"))).orderBy(F.xxhash64("key"), "key", "grade").limit(how.sample)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t, how.bits).astype(np.float16).tobytes() for t in raw(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("grade"), pa.array(x, pa.binary())], ["key", "grade", "x"])

    kind = found.schema["key"].dataType.simpleString()
    rows = sorted(kernel(found, work, f"key {kind}, grade int, x binary").limit(how.sample).toLocalIterator(), key=lambda r: (r["key"], r["grade"], bytes(r["x"])))
    x = np.empty((len(rows), 1 << how.bits), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], np.float16)
    return solve(x, np.array([r["grade"] for r in rows], np.int64), how)


def solve(x: np.ndarray, grade: np.ndarray, how: Fit) -> Model:
    """Maximum likelihood with weight decay by Adam over all rows.  Thresholds are a first
    one and positive steps, so they stay ordered."""
    n, cuts = len(x), how.grades - 1
    w = np.zeros(x.shape[1], np.float32)
    share = [np.clip((grade > k).mean() if n else 0.5, 0.01, 0.99) for k in range(cuts)]
    base = np.array([-np.log(s / (1 - s)) for s in share])
    steps = np.log(np.maximum(np.diff(base), 1e-2))
    params = np.concatenate([w, base[:1], steps]).astype(np.float64)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, how.steps + 1 if n else 1):
        w, cut = params[:-cuts].astype(np.float32), _ordered(params[-cuts:])
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(cut[None, :] - (x @ w).astype(np.float64)[:, None])), np.zeros((n, 1))], axis=1)
        hi, lo = tail[np.arange(n), grade], tail[np.arange(n), grade + 1]  # P(> grade - 1), P(> grade)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, -lo * (1 - lo) / p
        slope = (d_hi + d_lo) / n
        g_cut = np.array([-(d_hi[grade - 1 == k].sum() + d_lo[grade == k].sum()) / n for k in range(cuts)])
        g_own = np.r_[g_cut.sum(), [g_cut[k:].sum() * np.exp(params[-cuts:][k]) for k in range(1, cuts)]]
        grad = -np.concatenate([slope.astype(np.float32) @ x - how.decay * params[:-cuts], g_own])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= how.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model(params[:-cuts], _ordered(params[-cuts:]), how.bits)


def _ordered(own: np.ndarray) -> np.ndarray:
    return own[0] + np.concatenate([[0.0], np.cumsum(np.exp(own[1:]))])


def grade(docs: DataFrame, model: Model, pass_grade: int = 1, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, expected_grade, tail_probability, kept): one row per document.

    tail_probability is P(grade >= pass_grade), kept that it is at least `least`.  Null texts
    are empty ones; a null key counts as held out; repeated rows are graded alike; an empty table gives
    an empty table; without a rated row every text is graded by the start values."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = given.value
        tails = np.array([model.tails(features(t, model.bits)[None, :])[0] for t in raw(batch.column("text"))]).reshape(batch.num_rows, -1)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(tails.sum(axis=1)), pa.array(tails[:, pass_grade - 1]),
                                           pa.array(tails[:, pass_grade - 1] >= least)], [key, "held_out", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return kernel(rows, work, f"`{key}` {kind}, held_out boolean, expected_grade double, tail_probability double, kept boolean")
