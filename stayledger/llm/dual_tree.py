"""Ranked lexical search by two hierarchies.

Items form a tree, and so do the documents of every stretch of a task.  A node holds, per
term, the largest value any of its members has: how often an item asks for the term on one side,
what the term adds to a document's score on the other.  The product of two nodes bounds the score
of every (item, document) pair below them.  A pair of nodes whose bound is under the weakest
k-th score of the node's items goes, with all it holds; the others are split, level by level, and
what is left at the leaves is scored exactly.  Leaves are visited by rising hope, so thresholds
tighten early.

Thresholds start from an exact search of a hashed share of the documents: the k-th score there can
only be below the k-th of all.  They prune and decide nothing else; every document goes
through the search, and one that might tie is never pruned.

Items are taken in blocks of a bounded number of terms.  A block's items, its terms' weights and
the thresholds are all that is broadcast, and its terms' document counts all that is collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.shared import cut
from .common import kernel, raw

#: A term is a run of ASCII letters, digits and bytes beyond ASCII; A-Z are lower-cased.
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Term occurrences of a block of items; documents of a stretch and of a node on each level of its tree.
BLOCK_TERMS, STRETCH, LEVELS = 200_000, 8_192, (1_024, 128, 16)
#: Items of a node on each level of the items' tree; its last level are the items.
ITEM_LEVELS = (64, 8, 1)
#: One document in so many gives the first thresholds.
SHARE = 32
#: Floating point sums of whole numbers are exact below this.
EXACT = 1 << 53


def terms(text: bytes) -> list[bytes]:
    return text.translate(SEPARATED).split()


@dataclass
class Block:
    """Items of a block: their terms by number, and how often an item asks for each."""

    number: list[int]  # of the items
    vocabulary: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, list[bytes]]]) -> Block:
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts}))}
        asked = []
        for _, ts in rows:
            n = Counter(ts)
            asked.append((np.array([vocabulary[t] for t in n], np.int64), np.array(list(n.values()), np.int64)))
        return Block([i for i, _ in rows], vocabulary, asked)


def weights(n_documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def gains(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """A term's part of the score before its weight; all in whole numbers."""
    m = 100 - 25 + (25 * n * n_documents) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _maxima(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], kind: type) -> np.ndarray:
    """Dense matrix of the largest value per cell."""
    out = np.zeros(shape, kind)
    if len(rows):
        cell = rows * shape[1] + columns
        order = np.lexsort((values, cell))
        cell, values = cell[order], values[order]
        last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
        out.ravel()[cell[last]] = values[last]
    return out


class ItemTree:
    """Items in an order that keeps those with the same telling terms together, and node maxima."""

    def __init__(self, block: Block, weight: np.ndarray, kind: type):
        best = [tuple(t[np.argsort(-weight[t] * n, kind="stable")[:2]].tolist()) for t, n in block.asked]
        order = sorted(range(len(best)), key=best.__getitem__)
        self.number = np.array([block.number[i] for i in order], np.int64)
        asked = [block.asked[i] for i in order]
        rows = np.repeat(np.arange(len(asked)), [len(t) for t, _ in asked])
        columns = np.concatenate([t for t, _ in asked]) if asked else np.zeros(0, np.int64)
        values = np.concatenate([n for _, n in asked]) if asked else np.zeros(0, np.int64)
        self.levels = [_maxima(rows // size, columns, values, (-(-len(asked) // size), len(weight)), kind) for size in ITEM_LEVELS]


class Stretch:
    """Some documents, their tree, and the search of it by all items of a block."""

    def __init__(self, key: np.ndarray, known: np.ndarray, counts: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, kind: type):
        self.width, self.kind = width, kind
        doc = np.repeat(np.arange(len(counts)), counts)
        # siblings share their most telling term
        order = np.lexsort((term, value, doc))
        ends = np.cumsum(counts)
        lead = np.full(len(counts), -1)
        lead[counts > 0] = term[order][ends[counts > 0] - 1]
        place = np.empty(len(counts), np.int64)
        sequence = np.argsort(lead, kind="stable")
        place[sequence] = np.arange(len(counts))
        self.key, self.known = key[sequence], known[sequence]
        at = np.argsort(place[doc], kind="stable")
        self.doc, self.term, self.value = place[doc][at], term[at], value[at]
        self.start = np.searchsorted(self.doc, np.arange(len(counts) + 1))
        self.size = len(counts)

    def node_maxima(self, size: int) -> np.ndarray:
        return _maxima(self.doc // size, self.term, self.value, (-(-self.size // size), self.width), self.kind)

    def scores(self, first: int, last: int, items: np.ndarray) -> np.ndarray:
        """Exact scores of documents first..last for the given rows of items."""
        i, j = self.start[first], self.start[last]
        dense = np.zeros((last - first, self.width), self.kind)
        dense[self.doc[i:j] - first, self.term[i:j]] = self.value[i:j]
        return dense @ items.T


class Search:
    """Best k per item over stretches; `floor` are scores known to be reached by k documents."""

    def __init__(self, tree: ItemTree, floor: np.ndarray, k: int):
        n = len(tree.number)
        self.tree, self.k, self.floor = tree, k, floor.astype(np.int64)
        self.score = [np.zeros(0, np.int64)] * n
        self.key = [np.zeros(0, np.int64)] * n
        self.known = [np.zeros(0, bool)] * n
        self.visited = self.pairs = 0

    def over(self, s: Stretch) -> None:
        self.pairs += len(self.floor) * s.size
        alive = np.ones((1, 1), bool)
        of_item, of_doc = len(self.floor), s.size  # members of a node on the level before
        for item_size, size, asked in zip(ITEM_LEVELS, LEVELS, self.tree.levels):
            held = s.node_maxima(size)
            up_i = np.arange(asked.shape[0]) * item_size // max(of_item, 1)
            up_d = np.arange(held.shape[0]) * size // max(of_doc, 1)
            bound = asked @ held.T
            weakest = np.minimum.reduceat(self.floor, np.arange(0, len(self.floor), item_size))
            alive = alive[up_i][:, up_d] & (bound >= np.maximum(weakest, 1)[:, None])
            of_item, of_doc = item_size, size
        items, size = self.tree.levels[-1], LEVELS[-1]
        hope = np.where(alive, bound, 0).max(axis=0)
        for leaf in np.argsort(-hope, kind="stable").tolist():
            if hope[leaf] <= 0:
                break
            rows = np.flatnonzero(alive[:, leaf] & (bound[:, leaf] >= self.floor))
            if not len(rows):
                continue
            first, last = leaf * size, min((leaf + 1) * size, s.size)
            self.visited += len(rows) * (last - first)
            found = s.scores(first, last, items[rows]).astype(np.int64)
            for column, row in enumerate(rows.tolist()):
                self._take(row, found[:, column], s.key[first:last], s.known[first:last])

    def _take(self, row: int, score: np.ndarray, key: np.ndarray, known: np.ndarray) -> None:
        good = np.flatnonzero(score >= max(self.floor[row], 1))
        if not len(good):
            return
        score = np.concatenate([self.score[row], score[good]])
        key, known = np.concatenate([self.key[row], key[good]]), np.concatenate([self.known[row], known[good]])
        best = np.lexsort((key, ~known, -score))[: self.k]
        self.score[row], self.key[row], self.known[row] = score[best], key[best], known[best]
        if len(best) == self.k:
            self.floor[row] = max(self.floor[row], score[best[-1]])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = [len(x) for x in self.score]
        return np.repeat(self.tree.number, sizes), np.concatenate(self.score), np.concatenate(self.key), np.concatenate(self.known)


def _vectors(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """(key, known, n, term, tf): a document's length and its terms that the block's items use."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = shared.value
        lengths, numbers, times = [], [], []
        for content in raw(batch.column(1)):
            found = terms(content)
            lengths.append(len(found))
            number, n = np.unique(np.array([vocabulary[t] for t in found if t in vocabulary], np.int32), return_counts=True)
            numbers.append(number)
            times.append(n.astype(np.int32))
        keys = batch.column(0)
        offsets = np.cumsum([0, *map(len, numbers)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [keys.fill_null(0), keys.is_valid(), pa.array(lengths, pa.int64()),
             *[pa.ListArray.from_arrays(offsets, np.concatenate(x) if x else np.zeros(0, np.int32)) for x in (numbers, times)]],
            ["key", "known", "n", "term", "tf"])

    return kernel(docs.select(F.col(key).cast("long"), F.col(text).cast("string")), work,
                  "key long, known boolean, n long, term array<int>, tf array<int>")


def _best(vectors: DataFrame, block: Block, weight: np.ndarray, floor: dict[int, int], n_documents: int, n_terms: int, k: int) -> DataFrame:
    """(number, score, key, known): the best k of every item, in each task's documents."""
    most = max((int(n.sum()) for _, n in block.asked), default=0) * int(weight.max(initial=0)) * 1_000_000
    shared = vectors.sparkSession.sparkContext.broadcast((block, weight, floor))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, floor = shared.value
        kind = np.float64 if most < EXACT else np.int64
        tree = ItemTree(block, weight, kind)
        search = Search(tree, np.array([floor.get(i, 0) for i in tree.number.tolist()], np.int64), k)
        for batch in batches:
            for at in range(0, batch.num_rows, STRETCH):
                part = batch.slice(at, STRETCH)
                term, tf = part.column(3), part.column(4)
                counts = np.diff(term.offsets.to_numpy())
                number, times = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)
                n = np.repeat(part.column(2).to_numpy(), counts)
                value = weight[number] * gains(times, n, n_documents, n_terms)
                search.over(Stretch(part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), counts, number, value, len(weight), kind))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, search.rows())), ["number", "score", "key", "known"])

    return vectors.where("size(term) > 0").select("key", "known", "n", "term", "tf").mapInArrow(work, "number long, score long, key long, known boolean")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("known"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_of(docs: DataFrame, block: Block, k: int, key: str, text: str) -> DataFrame:
    vectors = cut(_vectors(docs, block, key, text), "vectors")
    n_documents, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("term").alias("term")).groupBy("term").count()  # a row per term of the block
    holding = np.zeros(len(block.vocabulary), np.int64)
    for row in held.toLocalIterator():
        holding[row[0]] = row[1]
    weight = weights(n_documents, holding)
    share = vectors.where(F.pmod(F.xxhash64("key", "n"), F.lit(SHARE)) == 0)
    first = _ranked(_best(share, block, weight, {}, n_documents, n_terms, k), k).where(F.col("rank") == k)
    floor = {r[0]: r[1] for r in first.select("number", "score").collect()}  # a row per item of the block
    return _ranked(_best(vectors, block, weight, floor, n_documents, n_terms, k), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): the `k` highest-scoring documents of every row of `items`.

    Only scores above 0 count, so an item may have fewer rows or none.  Null and empty texts have no terms;
    they score nothing and count nowhere.  Texts are read whole.  Equal scores rank by ascending key, a
    null key last; repeated documents rank one by one, in places next to each other.  A repeated row of
    `items` is searched once; rows of one id and different texts are ranked each on their own.
    Other columns are not read, whatever their names.  Empty tables give an empty result."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).alias("_item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).distinct()
    asked = cut(asked.withColumn("size", F.octet_length("_text")), "items")
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (8 * block_terms)))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b).orderBy("_item", "_text").collect()
        block = Block.of([(i, terms(r["_text"].encode())) for i, r in enumerate(rows)])
        if not block.vocabulary:
            continue
        schema = f"number long, `{item}` {items.schema[item].dataType.simpleString()}"
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], schema)
        found = cut(_block_of(docs, block, k, key, text).join(names, "number"), "found")
        part = found.select(item, F.col("rank").cast("int").alias("rank"), F.when(F.col("known"), F.col("key")).alias(key), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = items.schema[item].dataType.simpleString()
        out = spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` long, score long")
    return out
