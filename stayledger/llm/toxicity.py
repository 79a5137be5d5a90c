"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text.  The toxic one begins with the passages
(runs of one to `longest` words) that tell toxic training documents from ordinary ones, the other
with passages of ordinary documents.  Both end with the words that most documents use, which
therefore cost the same in both; the search is a full tree with fixed parameters, so that the size
of a dictionary changes nothing.  The windows of a text are its words and its runs of `span` words, one every `stride`
words and one at the end; how many bytes shorter a window is with the toxic dictionary is its
distance.  How many windows reach the thresholds, and how far the strongest goes, is calibrated
to a probability by logistic regression on the training documents.  
Windows are coded before compression.  In a word every byte is followed by two bytes of a hash
of the word up to it, so that matches respect beginnings of words and a whole word in the
dictionary is worth more than chance pieces of others.  In a run every pair of neighbours is eight
bytes of hashes, so that ordinary words match in the order of a passage alone: a telling passage
of three words or more is found even where each of its words is an ordinary one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.shared import cut
from .common import raw

#: Marks around a word that are no part of its window.
STRIP = b".,;:!?#$%&*|\"'()[]<>-"
#: Words whose lengths a worker remembers.
REMEMBERED = 400_000


#: Bytes of a stored window beside its own, and of a run that a telling word's beginning has: four letters' code but for two.
FRAME, RUN = 9, 10
#: Numbers that describe a document.
FEATURES = 12


@dataclass(frozen=True)
class Fit:
    """`sample` bounds the labelled rows used, `part` the bytes of either part of a dictionary, and
    with it what the driver gets: at most `part` words or passages of each kind, and one row of
    numbers for each of the sample's documents."""

    sample: int = 20_000
    part: int = 1 << 17
    longest: int = 4
    span: int = 16
    stride: int = 12
    least_documents: int = 3
    least_odds: float = 2.0
    near: int = 4
    span_near: tuple[int, int] = (5, 10)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    how: Fit
    weights: np.ndarray


def held_out(key: Column) -> Column:
    """One in five rows, by the CRC-32 of the key as text; labels of these are never read."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words(text: bytes) -> list[bytes]:
    return [x for x in (w.strip(STRIP) for w in text.lower().split()) if x]


def coded(word: bytes) -> bytes:
    h, out = 0, bytearray()
    for b in word:
        h = (h * 0x9E3779B1 + b + 1) & 0xFFFFFFFF
        out += bytes((b, h >> 24, h >> 16 & 255))
    return bytes(out)


def paired(found: list[bytes]) -> list[bytes]:
    """Eight bytes for each pair of neighbours."""
    return [pair_code(a + b" " + b) for a, b in zip(found, found[1:])]


def pair_code(pair: bytes) -> bytes:
    return (zlib.crc32(pair) << 32 | zlib.crc32(pair[::-1])).to_bytes(8, "big")


def passages(found: list[bytes], longest: int) -> set[bytes]:
    """Runs of two to `longest` words, joined by spaces."""
    return {b" ".join(found[i:i + n]) for n in range(2, longest + 1) for i in range(len(found) - n + 1)}


def own_parts(model: Model) -> tuple[set[bytes], set[int]]:
    """What the toxic dictionary holds before the end that both share: its runs of RUN bytes, and of four as numbers."""
    both = min(len(model.toxic), len(model.ordinary))
    ends = [np.frombuffer(d, np.uint8)[len(d) - both:][::-1] for d in (model.toxic, model.ordinary)]
    differ = np.flatnonzero(ends[0] != ends[1])
    own = model.toxic[:len(model.toxic) - int(differ[0] if len(differ) else both) + RUN - 1]
    return {own[i:i + RUN] for i in range(len(own) - RUN + 1)}, {int.from_bytes(own[i:i + 4], "big") for i in range(len(own) - 3)}


class Distance:
    """Bytes that a window is shorter with the toxic dictionary than with the ordinary one."""

    def __init__(self, model: Model):
        how = self.how = model.how
        search = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=19, search_log=5, min_match=5, target_length=64,
                                                     strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = [zstandard.ZstdCompressor(compression_params=search, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None)
                     for d in (model.ordinary, model.toxic)]
        self.known: dict[bytes, int] = {}
        self.parts, self.halves = own_parts(model)

    def of(self, window: bytes) -> int:
        return len(self.pair[0].compress(window)) - len(self.pair[1].compress(window))

    def __call__(self, word: bytes) -> int:
        return self.of(coded(word))

    def spans(self, found: list[bytes]) -> list[int]:
        """Distances of the runs of several words; one of all words where the text is shorter."""
        how, pairs = self.how, paired(found)
        last = len(found) - how.span
        starts = [*range(0, last, how.stride), last] if last > 0 else [0] if pairs else []
        return [self.of(b"".join(pairs[i:i + how.span - 1])) for i in starts]

    def gain(self, window: bytes) -> int:
        """The distance, or 0 if it is below: what the toxic dictionary doesn't shorten is stored, and nothing is longer."""
        size = len(self.pair[1].compress(window))
        return max(0, len(self.pair[0].compress(window)) - size) if size < len(window) + FRAME else 0

    def word_gain(self, word: bytes) -> int:
        """The gain of a word, remembered; 0 without compression if no word of the toxic part begins with its first four letters, as
        a reference to fewer saves nothing."""
        d = self.known.get(word)
        if d is None:
            begun = len(word) >= 4 and coded(word[:4])[:RUN] in self.parts
            d = self.gain(coded(word)) if begun else 0
            if len(self.known) < REMEMBERED:
                self.known[word] = d
        return d

    def gains(self, found: list[bytes]) -> list[int]:
        """The gains of `spans`.  Where no pair is one of the toxic part's own, and none comes twice, the toxic dictionary
        has nothing to refer to that the other lacks, and the window isn't compressed."""
        how, halves, crc32 = self.how, self.halves, zlib.crc32
        texts = [a + b" " + b for a, b in zip(found, found[1:])]
        telling = [i for i, p in enumerate(texts) if crc32(p) in halves]
        again = len(set(texts)) < len(texts)
        last = len(found) - how.span
        starts = [*range(0, last, how.stride), last] if last > 0 else [0] if texts else []
        out, at = [0] * len(starts), 0
        for k, i in enumerate(starts) if telling or again else ():
            while at < len(telling) and telling[at] < i:
                at += 1
            window = texts[i:i + how.span - 1]
            if at < len(telling) and telling[at] < i + len(window) or again and len(set(window)) < len(window):
                out[k] = self.gain(b"".join(map(pair_code, window)))
        return out

    def features(self, text: bytes) -> list[float]:
        found = words(text)
        counts = Counter(found)
        n, kinds = len(found), len(counts)
        far = {w: d for w in counts if (d := self.word_gain(w)) >= self.how.near}
        hits = sum(counts[w] for w in far)
        spans = self.gains(found)
        some, more = (sum(d >= k for d in spans) for k in self.how.span_near)
        return [1.0, np.log1p(hits), np.log1p(n), np.log1p(len(far)), np.log1p(kinds), hits / max(1, n), len(far) / max(1, kinds),
                min(1.0, max(far.values(), default=0) / 20), np.log1p(some), np.log1p(more), more / max(1, len(spans)),
                min(1.0, max(0, max(spans, default=0)) / 20)]


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on at most `how.sample` labelled rows that aren't held out, picked by hash of key.
    The sample's keys and labels are broadcast, its texts are written once.

    A key with several rows or labels counts with each of them, as far as the bound goes; rows with
    a null key or label are not used; null texts are empty ones; without rows the dictionaries are
    empty and the weights zero; passages in equally many documents are taken in byte order."""
    rated = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    picked = rated.select(F.col(key).alias("key"), (F.col(label) == 1).alias("toxic")).orderBy(F.xxhash64("key"), "key", "toxic").limit(how.sample)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key").select("toxic", "text")
    found = cut(found, "rated")
    runs_of_toxic = _counted(found.where("toxic"), how.longest, None).where(F.col("bad") >= how.least_documents)
    listed = [bytes(r["passage"]) for r in runs_of_toxic.orderBy(F.col("bad").desc(), "passage").limit(how.part // 8).collect()]
    seen = cut(_counted(found, how.longest, frozenset(listed)), "passages")
    size = seen.where(F.length("passage") == 0).first()
    bads, goods = (size["bad"], size["good"]) if size else (0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bads + 1.0)) - F.log((F.col("good") + 0.5) / (goods + 1.0))
    real = seen.where(F.length("passage") > 0).withColumn("odds", odds)
    telling = (F.col("bad") >= how.least_documents) & (F.col("odds") > how.least_odds)
    tell = _most(real.where(telling), "bad", how.part)
    usual = _most(real.where(~telling & ~F.col("passage").contains(F.lit(b" "))), "good", 2 * how.part)
    also = _most(real.where(~telling & F.col("passage").contains(F.lit(b" ")) & (F.col("good") >= how.least_documents)), "good", how.part)
    shared, rest = _filled(usual, how.part)
    toxic, ordinary = _filled(tell, how.part)[0], _filled(sorted([*also, *rest], key=lambda r: (-r[1], r[0])), how.part)[0]
    model = Model(ordinary + shared, toxic + shared, how, np.zeros(FEATURES))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = Distance(given.value)
        for batch in batches:
            x = [far.features(t) for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    measured = found.mapInArrow(measure, "toxic boolean, x array<double>").orderBy("x", "toxic").limit(how.sample)
    rows = sorted((r["x"], r["toxic"]) for r in measured.collect())
    x, y = np.array([r[0] for r in rows]).reshape(-1, FEATURES), np.array([r[1] for r in rows], float)
    return Model(model.ordinary, model.toxic, how, calibrated(x, y))


def _counted(found: DataFrame, longest: int, listed: frozenset | None) -> DataFrame:
    """(passage, bad, good): documents of either label that hold a passage; the empty one counts all.
    With `listed`, words and these runs of words; without it, all runs and no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, ordinary = Counter(), Counter()
            for content, bad in zip(raw(batch.column("text")), batch.column("toxic").to_pylist()):
                seen = words(content)
                several = passages(seen, longest)
                (toxic if bad else ordinary).update(several if listed is None else {b"", *seen, *(several & listed)})
            every = list(toxic | ordinary)
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([toxic[w] for w in every], pa.int64()),
                                              pa.array([ordinary[w] for w in every], pa.int64())], ["passage", "bad", "good"])

    counts = found.mapInArrow(count, "passage binary, bad long, good long")
    return counts.groupBy("passage").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _most(rows: DataFrame, by: str, part: int) -> list[tuple[bytes, int]]:
    """The passages of most documents; a passage takes three bytes of a dictionary at the least."""
    return [(bytes(r["passage"]), r[by]) for r in rows.orderBy(F.col(by).desc(), "passage").limit(part // 3).collect()]


def _filled(ranked: list[tuple[bytes, int]], part: int) -> tuple[bytes, list[tuple[bytes, int]]]:
    """Coded passages up to `part` bytes, the first ranked last, where they are cheapest to refer
    to, and the passages that found no room."""
    taken, held = [], 0
    for passage, _ in ranked:
        run = passage.split(b" ")
        code = b"".join(paired(run)) if len(run) > 1 else coded(passage)
        if held + len(code) > part:
            break
        taken.append(code)
        held += len(code)
    return b"".join(reversed(taken)), ranked[len(taken):]


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(x) else 0):
        p = probability(x, w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted): one row per document, from its whole text.

    Null texts are empty ones and are scored; a null key counts as held out; repeated rows
    are scored alike; a long text has as many windows as it has room for; an empty table gives an empty table; without labelled rows every
    score is 0.5."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        far = Distance(model)
        for batch in batches:
            p = probability(np.array([far.features(t) for t in raw(batch.column("text"))]).reshape(-1, FEATURES), model.weights)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             [key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, held_out boolean, score double, predicted int")
