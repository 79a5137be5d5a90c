"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has one bit per position of the shingle hashes: set if more than half of
them have it set.  Two fingerprints that differ in at most `max_bits` of 64 positions,
cut into max_bits + 1 consecutive segments around a ring, have a segment from which every
chain of consecutive segments stays within its proportional budget: the first l segments
differ in at most floor(l * max_bits / (max_bits + 1)) bits together.  So

1. equal fingerprints become one class (pre-aggregated, copies are never paired up);
2. classes meet on an equal first segment, split into blocks where a segment is common;
3. inside a block the next segment's budget (one bit at most) is looked up in sorted
   order, the chain is followed around the ring, and what survives gets the full test;
4. of the links found a block gives a spanning forest only, and components are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut
from .common import cells, forest, kernel, raw, runs
from .components import components

BITS = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of all shingles: ASCII lower case, words joined by single spaces."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:][:n]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    ones, rows = np.zeros(BITS, np.int64), 255  # a byte holds the sum of 255 bits
    bits = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), rows * 256):
        part = np.unpackbits(bits[at:at + rows * 256], axis=1)
        full = len(part) // rows * rows
        ones += part[:full].reshape(-1, rows, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += part[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint_of(text: bytes, width: int) -> int:
    """Unsigned fingerprint of one text; no words: 0."""
    return majority(shingle_hashes(text, width))


def wide_fingerprint(hashes: np.ndarray, count: int) -> bytes:
    """`count` fingerprints of shingle hashes by as many hash functions, 64 bits each."""
    out = []
    for k in range(count):
        h = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % 2 ** 64)  # hash functions out of one: a mixing step from another start
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(h ^ (h >> np.uint64(31))))
    return np.array(out, np.uint64).tobytes()


def with_fingerprint(docs: DataFrame, width: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with a signed 64-bit fingerprint column; null or wordless text: 0."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint_of(t, width) for t in raw(batch.column(text))], np.uint64).view(np.int64)
        return batch.append_column(pa.field(out, pa.int64(), False), pa.array(prints, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return kernel(docs, work, f"{schema}, `{out}` long" if schema else f"`{out}` long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments, from the low bits up."""
    n = max_bits + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, max_bits: int = 4, block: int = 4096) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fp` exactly as all pairs of
    at most `max_bits` differing bits do (a spanning forest of every block)."""
    if not max_bits:  # equal fingerprints are one class already
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    ring = segments(max_bits)
    unsigned = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in ring]
    keyed = prints.select("fp", F.posexplode(F.array(*unsigned)).alias("seg", "value"))
    dealt = cells(keyed, ["seg", "value"], "fp", block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, ["seg", "value", "cell_a", "cell_b"]):
            fp = t["fp"].to_numpy().view(np.uint64)
            seg, own = t["seg"].to_numpy(), t["own_block"].to_numpy()
            cross = t["cell_a"].to_numpy() != t["cell_b"].to_numpy()
            for s in range(len(ring)):
                here = (seg[starts] == s) & (ends - starts > 1)
                a, b = _ring_pairs(fp, starts[here], ends[here], own, cross, s, ring, max_bits)
                x, y = forest(fp[a].view(np.int64), fp[b].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    where = ["seg", "value", "cell_a", "cell_b"]
    return (dealt.repartition(*where).sortWithinPartitions(*where)
            .select(*where, "fp", "own_block").mapInArrow(work, "a long, b long"))


#: Pairs looked at in one step.
SLICE = 1 << 18


class _Joined:
    """Which of `n` rows are connected: `least` has the smallest row that each row reaches."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.least[a] != self.least[b]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        moved, to = forest(self.least[a], self.least[b])
        if len(moved):
            now = np.arange(len(self.least))
            now[moved] = to
            self.least = now[self.least]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.least != np.arange(len(self.least)))
        return moved, self.least[moved]


def _ring_pairs(fp, starts, ends, own, cross, s, ring, max_bits) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of the same group that pass the chain from segment
    `s` on and the full test; pairs that are connected already are not looked at again.  The second segment may differ by one bit: groups are sorted by its value and
    every one-bit neighbour is looked up."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none
    sizes = ends - starts
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    n = len(ring)
    budgets = [length * max_bits // n for length in range(1, n + 1)]
    shift, width = ring[(s + 1) % n]
    value = (fp[rows] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    key = (group.astype(np.uint64) << np.uint64(width)) | value
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    joined = _Joined(len(fp))
    flips = [0] + [1 << i for i in range(width)] if budgets[1] else [0]
    for flip in flips:
        left = np.searchsorted(key, key ^ np.uint64(flip), "left")
        right = np.searchsorted(key, key ^ np.uint64(flip), "right")
        count = right - left
        at = 0
        while at < len(key):  # in slices of a bounded number of pairs
            upto = max(at + 1, int(np.searchsorted(np.cumsum(count[at:at + SLICE]), SLICE, "right")) + at)
            c = count[at:upto]
            i = np.repeat(np.arange(at, upto), c)
            j = np.repeat(left[at:upto] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
            ok = i < j
            a, b = rows[i[ok]], rows[j[ok]]
            ok = (~cross[a] | (own[a] != own[b])) & joined.apart(a, b)
            a, b = a[ok], b[ok]
            gone = np.zeros(len(a), np.int64)
            for step in range(1, n):
                sh, w = ring[(s + step) % n]
                gone += np.bitwise_count(((fp[a] ^ fp[b]) >> np.uint64(sh)) & np.uint64((1 << w) - 1))
                ok = gone <= budgets[step]
                a, b, gone = a[ok], b[ok], gone[ok]
            a, b = a.astype(np.int64), b.astype(np.int64)
            ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            joined.add(a[ok], b[ok])
            at = upto
    return joined.edges()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, block: int = 4096,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as long, component_id): one row per document.

    component_id is the smallest key reachable by links.  Null and wordless texts have
    fingerprint 0 and link like any other; a null key never is a component_id unless all
    keys of the component are null; repeated rows are rows of one class; an empty table
    gives an empty table; other columns are not read."""
    prints = cut(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), width)
                 .select("key", F.col("fingerprint").alias("fp")), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    found = components(links(classes.select("fp"), max_bits, block))
    root = F.coalesce("component", "fp")
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", root)
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return (prints.join(named.select("fp", "component_id"), "fp")
            .select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id"))


def most_bits(similarity: float, bits: int, errors: float = 3) -> int:
    """Differing bits, of `bits`, that shingle sets of this Jaccard similarity reach: the
    expected number and so many standard errors."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + errors * np.sqrt(bits * share * (1 - share)))


def _boxes(prints: list[bytes], per_word: int) -> np.ndarray:
    """(n, boxes) segments of wide fingerprints; none crosses a 64-bit word."""
    words = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    return np.concatenate([(words >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in segments(per_word - 1)], axis=1).astype(np.uint32)


def wide_links(prints: DataFrame, bits: int, max_bits: int, boxes: int, block: int = 4096, slack: int = 4) -> DataFrame:
    """(a, b): links between distinct wide fingerprints (node: long, fp: binary) of at most
    `max_bits` differing bits, as spanning forests of blocks.

    For budgets as wide as word-shingle similarities need, a ring of max_bits + 1 segments
    has segments of a bit or two, which most pairs share.  So the ring has fewer segments: a pair is
    a candidate if one of them is equal, and is followed from there as long as its
    differences stay within the proportional budget plus `slack`, then gets the full test.
    Of pairs that differ in a share p of the bits, about 1 - (1 - (1 - p) ** w) ** boxes
    have an equal segment of width w (p 0.15: 96 % with 25 boxes of
    13 bits, 99.7 % with 30 of 10 or 11)."""
    per_word = boxes // (bits // BITS)
    ring = per_word * (bits // BITS)

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        values = _boxes(batch.column("fp").to_pylist(), per_word) if n else np.zeros((0, ring), np.uint32)
        at = pa.array(np.repeat(np.arange(n), ring))
        return pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array(np.tile(np.arange(ring, dtype=np.int32), n)),
                                           pa.array(values.reshape(-1).astype(np.int32)), batch.column("fp").take(at)], ["node", "seg", "value", "fp"])

    keyed = kernel(prints.select("node", "fp"), key, "node long, seg int, value int, fp binary")
    dealt = cells(keyed, ["seg", "value"], "node", block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, ["seg", "value", "cell_a", "cell_b"]):
            ring_values = _boxes(t["fp"].to_pylist(), per_word)
            a, b = _chained(ring_values, starts, ends, t["seg"].to_numpy(), t["own_block"].to_numpy(),
                            t["cell_a"].to_numpy() != t["cell_b"].to_numpy(), max_bits, slack)
            node = t["node"].to_numpy()
            x, y = forest(node[a], node[b])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    where = ["seg", "value", "cell_a", "cell_b"]
    return (dealt.repartition(*where).sortWithinPartitions(*where).select(*where, "node", "fp", "own_block").mapInArrow(work, "a long, b long"))


def _chained(ring, starts, ends, seg, own, cross, max_bits, slack) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows of the same group whose chain from the equal segment
    on stays in budget; pairs that are connected already are not looked at again."""
    n, boxes = ring.shape
    sizes = ends - starts
    partners = np.repeat(ends, sizes) - np.arange(n) - 1
    done = np.cumsum(partners)
    joined, at = _Joined(n), 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + SLICE, "right")))
        c = partners[at:upto]
        a = np.repeat(np.arange(at, upto), c)
        b = a + 1 + np.arange(c.sum()) - np.repeat(np.r_[0, np.cumsum(c)[:-1]], c)
        ok = (~cross[a] | (own[a] != own[b])) & joined.apart(a, b)
        a, b = a[ok], b[ok]
        gone = np.zeros(len(a), np.int64)
        for step in range(1, boxes):
            box = (seg[a] + step) % boxes
            gone += np.bitwise_count(ring[a, box] ^ ring[b, box])
            ok = gone <= ((step + 1) * max_bits // boxes + slack if step < boxes - 1 else max_bits)
            a, b, gone = a[ok], b[ok], gone[ok]
        joined.add(a, b)
        at = upto
    return joined.edges()


def verified_links(members: DataFrame, max_bits: int, similarity: float, block: int = 1024) -> DataFrame:
    """(a, b): links between rows (component, node, fp, shingles: sorted distinct hashes) of one
    component that connect them exactly as all pairs do that differ in at most `max_bits`
    bits and have this Jaccard similarity of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in runs(batches, ["component", "cell_a", "cell_b"]):
            node, own = t["node"].to_numpy(), t["own_block"].to_numpy()
            cross = t["cell_a"].to_numpy() != t["cell_b"].to_numpy()
            words = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(len(node), -1)
            column = t["shingles"].combine_chunks()
            edges, values = column.offsets.to_numpy(), column.values.to_numpy()
            sets = [values[x:y] for x, y in zip(edges, edges[1:])]
            found = [pair for x, y in zip(starts.tolist(), ends.tolist()) for pair in _similar(words, sets, own, cross[x], x, y, max_bits, similarity)]
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

    where = ["component", "cell_a", "cell_b"]
    return (cells(members, ["component"], "node", block).repartition(*where).sortWithinPartitions(*where)
            .select(*where, "node", "fp", "shingles", "own_block").mapInArrow(work, "a long, b long"))


def _similar(words, sets, own, cross, start, end, max_bits, similarity) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs of the rows from `start` to `end`: pairs that are
    connected already are not looked at again."""
    root, found = np.arange(start, end), []
    for i in range(start, end):
        ok = root[i - start + 1:] != root[i - start]
        if cross:
            ok &= own[i + 1:end] != own[i]
        others = np.flatnonzero(ok) + i + 1
        others = others[np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64) <= max_bits]
        for j in others.tolist():
            if root[j - start] != root[i - start] and jaccard_at_least(sets[i], sets[j], similarity):
                root[root == root[j - start]] = root[i - start]
                found.append((i, j))
    return found


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of sorted distinct hashes."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 5, boxes: int = 30, block: int = 4096,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of near-duplicates: that of the smallest key (null last).

    Near are texts whose sets of `width`-word shingles have this Jaccard similarity or more, and
    what such links connect.  Fingerprints of 64 * `words` bits over the sets only find the
    candidates; the sets decide.  Texts without words are one group; repeated rows are copies;
    all columns stay as they are."""
    uid, mark, node = "_simhash_row", "_simhash_print", "_simhash_node"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, nodes = [], []
        for content in batch.column(text).cast(pa.binary()):  # one text and one set at a time
            found = np.unique(shingle_hashes(content.as_py() or b"", width))
            prints.append(wide_fingerprint(found, words))
            nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2 ** 63)
        return batch.append_column(pa.field(mark, pa.binary()), pa.array(prints, pa.binary())).append_column(
            pa.field(node, pa.int64()), pa.array(nodes, pa.int64()))

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in raw(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "node", "fp")), pa.array(sets, pa.list_(pa.int64()))],
                                          ["component", "node", "fp", "shingles"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = cut(kernel(docs, work, f"{schema}, {mark} binary, {node} long").withColumn(uid, F.monotonically_increasing_id()), "marked")
    best = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), F.col(uid).alias("uid"))).alias("best")
    classes = cut(marked.groupBy(F.col(node).alias("node")).agg(F.first(mark).alias("fp"), best), "classes")
    bits = BITS * words
    most = most_bits(similarity, bits)
    near = components(wide_links(classes, bits, most, boxes, block)).withColumnRenamed("node", "_node")
    near = classes.join(near, F.col("node") == F.col("_node")).select("component", "node", "fp", F.col("best.uid").alias("uid"))
    near = near.join(marked.select(F.col(uid).alias("uid"), F.col(text).alias("text")), "uid").select("component", "node", "fp", "text")
    members = cut(kernel(near, shingled, "component long, node long, fp binary, shingles array<long>"), "members")
    found = components(verified_links(members, most, similarity))
    rooted = classes.select("node", "best").join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("best").alias("best"))
    return marked.join(rooted.select(F.col("best.uid").alias(uid)), uid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
