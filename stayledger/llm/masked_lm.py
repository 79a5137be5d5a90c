"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every word is predicted from the words on both of its sides:
    h = tanh(sum over offsets k of E_k[word at k] + b)
    p(word) = softmax(h Wc + bc)[class] * softmax(h U + B[class])[member] * P(word | entry)
A document's score is the sum of the logarithms of these conditionals.

The network's entries come from word counts over the whole corpus: frequent words have their
own, where P(word | entry) is 1; the others share hashed entries, and their P is that of the
word among all counted words of its entry.  The number of entries grows with the square root of
the number of distinct words (`Shape.of`).  The table of counts is as large as the corpus
makes it and stays in Spark; words it does not have share what Witten-Bell smoothing leaves
an entry, spelled in bytes.  Training reads the whole corpus too: from one common start, which is the
unigram model of the counts, every partition trains a network in numpy on its own words,
and the networks' steps are averaged, weighted by words.  The averages are summed in
integers, so they don't depend on the order in which partitions end.

Documents meet the word counts in lots, one for each Arrow batch: a lot's distinct words of shared
entries travel once each, not once per document, and come back as numbers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut
from .common import kernel, runs

#: Offsets of the context words.
OFFSETS = (-2, -1, 1, 2)
REACH = 2
#: Words counted in a worker's memory before they are passed on.
HELD_WORDS = 200_000
#: Fixed-point scale of averaged steps, words a unit of weight stands for, values a row carries.
SCALE, UNIT, PIECE = 1 << 20, 1024, 1024


@dataclass(frozen=True)
class Shape:
    """classes * members entries, of which the last `hashed` are shared by rare words."""

    classes: int = 32
    members: int = 32
    hashed: int = 256
    width: int = 16
    batch: int = 8192
    rate: float = 0.05
    seed: int = 11

    @classmethod
    def of(cls, kinds: int) -> Shape:
        """For a corpus of `kinds` distinct words: a power of two of at least 1,024 and of
        about sqrt(kinds) entries, a quarter of them shared."""
        power = max(10, math.ceil(math.log2(max(1, kinds)) / 2))
        return cls(1 << (power + 1) // 2, 1 << power // 2, 1 << power - 2)

    @property
    def entries(self) -> int:
        return self.classes * self.members

    @property
    def frequent(self) -> int:
        return self.entries - self.hashed


class Vocabulary(dict):
    """Word -> entry; words beyond the frequent ones are hashed."""

    def __init__(self, words: list[bytes], shape: Shape):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.hashed, self.frequent = shape.frequent, shape.hashed, pa.array(words, pa.binary())

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word) % self.hashed

    def entries(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.frequent)
        entry = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        other = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        entry[other] = [self[w] for w in words.take(pa.array(other)).to_pylist()]
        return entry


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts in ASCII lower case: `at` points into the distinct `words`."""

    at: np.ndarray
    words: pa.Array
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat = pieces.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]]
        coded = flat.filter(real).dictionary_encode()
        return cls(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()), np.diff(ends))

    def padded(self, entries: np.ndarray, pad: int) -> np.ndarray:
        """Entries of all texts, each with padding on both sides."""
        ids = np.full(len(self.at) + REACH * (len(self.sizes) + 1), pad, np.int32)
        ids[np.arange(len(self.at)) + REACH * (1 + np.repeat(np.arange(len(self.sizes)), self.sizes))] = entries[self.at]
        return ids


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; ASCII lower case.  Counted in tasks, then summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            w = Words.of(batch.column(0))
            held.append(pa.table({"word": w.words, "n": np.bincount(w.at, minlength=len(w.words)).astype(np.int64)}))
            if sum(t.num_rows for t in held) > HELD_WORDS:
                held = [_added(held)]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _added(held).to_batches()

    return docs.select(text).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


class Network:
    """Parameters in one flat vector, with views by name."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        c, m, d = shape.classes, shape.members, shape.width
        at = 0
        for name, size in (("E", (shape.entries + 1, len(OFFSETS) * d)), ("b", (d,)), ("Wc", (d, c)), ("bc", (c,)), ("U", (d, m)), ("B", (c, m))):
            n = int(np.prod(size))
            setattr(self, name, flat[at:at + n].reshape(size))
            at += n

    @staticmethod
    def size(shape: Shape) -> int:
        c, m, d = shape.classes, shape.members, shape.width
        return len(OFFSETS) * (shape.entries + 1) * d + d + d * c + c + d * m + c * m

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray) -> Network:
        """Small random weights; biases are the unigram model of the entries' counts."""
        rng = np.random.default_rng(shape.seed)
        net = cls(shape, (rng.normal(size=cls.size(shape)) * 0.1).astype(np.float32))
        share = (counts + 1.0).reshape(shape.classes, shape.members)
        net.bc[:] = np.log(share.sum(axis=1) / share.sum())
        net.B[:] = np.log(share / share.sum(axis=1, keepdims=True))
        return net

    def forward(self, ids: np.ndarray):
        """Of every inner position of `ids`: hidden units, class, and both rows of logits side by
        side, held within +-80 where their exponentials are finite."""
        n, d = len(ids) - 2 * REACH, self.shape.width
        rows = self.E[ids]
        h = self.b + rows[REACH + OFFSETS[0]:][:n, :d]
        for i, k in enumerate(OFFSETS[1:], 1):
            h += rows[REACH + k:][:n, i * d:(i + 1) * d]
        np.tanh(h, out=h)
        cls = np.minimum(ids[REACH:REACH + n] // self.shape.members, self.shape.classes - 1)
        z = h @ np.concatenate([self.Wc, self.U], axis=1)
        z[:, :self.shape.classes] += self.bc
        z[:, self.shape.classes:] += self.B[cls]
        return h, cls, np.clip(z, -80, 80, out=z)

    def sums(self, e: np.ndarray) -> np.ndarray:
        """Of each row of exponentials: the sum over classes, and that over members."""
        halves = np.zeros((e.shape[1], 2), e.dtype)
        halves[:self.shape.classes, 0] = halves[self.shape.classes:, 1] = 1
        return e @ halves

    def log_prob(self, ids: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every inner position; 0 at padding."""
        n = len(ids) - 2 * REACH
        _, cls, z = self.forward(ids)
        target, at = ids[REACH:REACH + n], np.arange(n)
        chosen = z[at, cls].astype(np.float64) + z[at, self.shape.classes + target % self.shape.members]
        s = self.sums(np.exp(z, out=z)).astype(np.float64)
        return np.where(target < self.shape.entries, chosen - np.log(s[:, 0] * s[:, 1]), 0.0)

    def train(self, ids: np.ndarray, squares: Network) -> None:
        """One Adagrad step on the inner positions of `ids`."""
        n, c, d = len(ids) - 2 * REACH, self.shape.classes, self.shape.width
        target, at = ids[REACH:REACH + n], np.arange(n)
        real = (target < self.shape.entries).astype(np.float32) / max(1, n)
        h, cls, z = self.forward(ids)
        dz = np.exp(z, out=z)
        scale = real[:, None] / self.sums(dz)
        dz[:, :c] *= scale[:, :1]
        dz[:, c:] *= scale[:, 1:]
        dz[at, cls] -= real
        dz[at, c + target % self.shape.members] -= real
        dh = (dz @ np.concatenate([self.Wc, self.U], axis=1).T) * (1 - h * h)
        dw = h.T @ dz
        self._step("Wc", dw[:, :c], squares)
        self._step("bc", dz[:, :c].sum(axis=0), squares)
        self._step("U", dw[:, c:], squares)
        self._step("b", dh.sum(axis=0), squares)
        self._step("B", _rows_summed(dz[:, c:], cls, c), squares)
        around = np.zeros((len(ids), len(OFFSETS) * d), dh.dtype)
        for i, k in enumerate(OFFSETS):  # ids[j] is the context at offset k of inner position j - REACH - k
            around[REACH + k:][:n, i * d:(i + 1) * d] = dh
        self._step("E", _rows_summed(around, ids, self.shape.entries + 1), squares)

    def _step(self, name: str, grad: np.ndarray, squares: Network) -> None:
        s = getattr(squares, name)
        s += grad * grad
        getattr(self, name)[...] -= self.shape.rate * grad / (np.sqrt(s) + 1e-8)


def _rows_summed(x: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, x.shape[1]), x.dtype)
    order = np.argsort(by.astype(np.uint16) if n <= 1 << 16 else by, kind="stable")
    starts = np.flatnonzero(np.r_[True, by[order[1:]] != by[order[:-1]]])
    out[by[order[starts]]] = np.add.reduceat(x[order], starts, axis=0)
    return out


@dataclass(frozen=True)
class Model:
    """`rare`: (word, log_share) of the words that share entries; `unseen`: the logarithm of what
    each shared entry leaves to words that were not counted."""

    shape: Shape
    words: list[bytes]
    flat: np.ndarray
    rare: DataFrame
    unseen: list[float]


def fit(docs: DataFrame, shape: Shape | None = None, text: str = "text") -> Model:
    """Count, start and train; without a shape, that of `Shape.of` the distinct words.  The driver
    gets the frequent words and entries' counts (at most shape.entries rows) and one averaged
    network: some 300 bytes for each of about sqrt(distinct words) entries.

    Null and wordless texts count for nothing; repeated rows count as often as they occur; an
    empty table gives the untrained start; words equally frequent take entries in byte order."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs, text), "word_counts")
    shape = shape or Shape.of(counts.count())
    top = counts.orderBy(F.col("n").desc(), "word").limit(shape.frequent).collect()
    words = [bytes(r["word"]) for r in top]
    rest = counts.join(spark.createDataFrame([(w,) for w in words], "word binary"), "word", "left_anti")
    entry = F.crc32("word") % shape.hashed
    rows = rest.groupBy(entry.alias("h")).agg(F.sum("n").alias("n"), F.count("n").alias("kinds")).collect()
    hashed, kinds = {r["h"]: r["n"] for r in rows}, {r["h"]: r["kinds"] for r in rows}
    whole = [hashed.get(h, 0) + kinds.get(h, 0) + 1 for h in range(shape.hashed)]
    unseen = [math.log((kinds.get(h, 0) + 1) / n) for h, n in enumerate(whole)]
    of_entry = spark.createDataFrame([(h, math.log(n)) for h, n in enumerate(whole)], "h long, log_whole double")
    rare = rest.withColumn("h", entry).join(of_entry, "h").select("word", (F.log("n") - F.col("log_whole")).alias("log_share"))
    of_entries = np.zeros(shape.entries)
    of_entries[:len(top)] = [r["n"] for r in top]
    of_entries[shape.frequent:] = [hashed.get(h, 0) for h in range(shape.hashed)]
    start = Network.start(shape, of_entries).flat
    given = spark.sparkContext.broadcast((words, start))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = given.value
        vocabulary = Vocabulary(words, shape)
        net = Network(shape, start.copy())
        squares = Network(shape, np.full(len(start), 1e-6, np.float32))
        seen = 0
        for batch in batches:
            found = Words.of(batch.column(0))
            ids = found.padded(vocabulary.entries(found.words), shape.entries)
            seen += len(found.at)
            for at in range(0, len(ids) - 2 * REACH, shape.batch):
                net.train(ids[at:at + shape.batch + 2 * REACH], squares)
        if seen:
            weight = -(-seen // UNIT)
            moved = np.rint((net.flat - start).astype(np.float64) * SCALE).astype(np.int64) * weight
            pieces = [moved[i:i + PIECE] for i in range(0, len(moved), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([weight] * len(pieces), pa.int64()),
                                              pa.array(pieces, pa.list_(pa.int64()))], ["piece", "weight", "moved"])

    moves = docs.select(text).mapInArrow(work, "piece int, weight long, moved array<long>")
    flat = start.astype(np.float64)
    for r in moves.repartition("piece").mapInArrow(_summed, "piece int, weight long, moved array<long>").collect():
        flat[r["piece"] * PIECE:][:len(r["moved"])] += np.array(r["moved"], np.float64) / r["weight"] / SCALE
    return Model(shape, words, flat.astype(np.float32), rare, unseen)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the rows of each piece; holds one row of fixed length for each piece."""
    held: dict[int, list] = {}
    for batch in batches:
        for piece, weight, moved in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2)):
            moved = moved.values.to_numpy()
            if piece in held:
                held[piece][0] += weight
                held[piece][1] = held[piece][1] + moved
            else:
                held[piece] = [weight, moved]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([w for w, _ in held.values()], pa.int64()),
                                      pa.array([m for _, m in held.values()], pa.list_(pa.int64()))], ["piece", "weight", "moved"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob): one row per document, from its whole text.

    Null and wordless texts have 0 tokens, log_prob 0 and a null mean; repeated rows get
    equal scores but for rounding; an empty table gives an empty table.  The network's part is
    written with the places (four bytes each) of each document's words of shared entries among those of its lot;
    a lot is an Arrow batch, named by its first row."""
    given = docs.sparkSession.sparkContext.broadcast((model.shape, model.words, model.flat, np.array(model.unseen)))
    row = F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("n"))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    into = f"lot long, row {kind}, n_tokens long, log_prob double, rare binary, words array<struct<word: binary, spelled: long>>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shape, words, flat, unseen = given.value
        net, vocabulary, found = Network(shape, flat), Vocabulary(words, shape), Words.of(batch.column(1))
        entries = vocabulary.entries(found.words)
        ids, n = found.padded(entries, shape.entries), batch.num_rows
        logs = [net.log_prob(ids[at:at + shape.batch + 2 * REACH]) for at in range(0, len(ids) - 2 * REACH, shape.batch)]
        sums = np.r_[0.0, np.cumsum(np.concatenate(logs) if logs else np.zeros(0))]
        last = np.cumsum(found.sizes + REACH) - REACH
        shared = entries >= shape.frequent
        place = np.cumsum(shared, dtype=np.int32) - 1
        which = shared[found.at]
        ends = np.r_[0, np.cumsum(which)][np.r_[0, np.cumsum(found.sizes)]]
        own = found.words.filter(pa.array(shared))
        length = pc.binary_length(own).to_numpy(zero_copy_only=False)
        spelled = np.rint((unseen[entries[shared] - shape.frequent] - (length + 1) * math.log(257)) * SCALE).astype(np.int64)
        of_lot = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n, len(own))], pa.int32()), pa.StructArray.from_arrays([own, pa.array(spelled)], ["word", "spelled"]))
        lot = batch.column(0).field("n")[0].as_py() if n else 0
        places = place[found.at[which]].astype(np.int32)
        rare = pa.Array.from_buffers(pa.binary(), n, [None, *map(pa.py_buffer, ((4 * ends).astype(np.int32), places))])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, lot)), batch.column(0), pa.array(found.sizes), pa.array(sums[last] - sums[last - found.sizes]),
             rare, of_lot],  # the first row of a lot has its words
            ["lot", "row", "n_tokens", "log_prob", "rare", "words"])

    scored = cut(kernel(rows, work, into), "scored")
    used = scored.select("lot", F.posexplode("words").alias("at", "w")).select("lot", "at", "w.word", "w.spelled")
    part = F.coalesce(F.round(F.col("log_share") * SCALE).cast("long"), "spelled")  # whole numbers: no order of adding matters
    shares = used.join(model.rare, "word", "left").select("lot", "at", part.alias("part"))
    both = shares.unionByName(scored.drop("words"), allowMissingColumns=True)
    # Places are bytes because a list, empty too, costs a row 20 microseconds on its way to Python.
    # One whole number as the key: Spark sorts it by radix, while a lot's many rows of a two-column key are compared one by one.
    ordered = both.repartition("lot").sortWithinPartitions(F.shiftleft("lot", 1).bitwiseOR(F.col("row").isNotNull().cast("long")))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, ["lot"]):
            for start, end in zip(starts, ends):
                lot = t.slice(start, end - start)
                at = lot["at"].drop_null().to_numpy()
                parts = np.zeros(len(at), np.int64)
                parts[at] = lot["part"].slice(0, len(at)).to_numpy()
                rows = lot.slice(len(at)).combine_chunks()
                if not rows.num_rows:
                    continue
                ends_of = np.cumsum(pc.binary_length(rows["rare"]).to_numpy()) // 4
                upto = np.r_[0, np.cumsum(parts[np.frombuffer(b"".join(rows["rare"].to_pylist()), np.int32)])]
                own = upto[ends_of] - upto[np.r_[0, ends_of[:-1]]]
                n, log = rows["n_tokens"].to_numpy(), rows["log_prob"].to_numpy() + own / SCALE
                mean = pa.array(log / np.maximum(n, 1), mask=n == 0)
                keys = pc.struct_field(rows["row"], "key").combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(log), mean], ["key", "n_tokens", "log_prob", "mean_log_prob"])

    inner = scored.select("row.key").schema["key"].dataType.simpleString()
    return ordered.mapInArrow(total, f"key {inner}, n_tokens long, log_prob double, mean_log_prob double").withColumnRenamed("key", key)
