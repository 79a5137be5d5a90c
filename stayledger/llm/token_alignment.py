"""Alignment of two tokenizers' tokens by merge paths.

Both tokenizers spell the same bytes, so the ends of their tokens are two ascending lists of
offsets.  Merging the two lists is a path of right and down steps; a binary search along a
diagonal finds where the path crosses it, without walking the path.  Diagonals at equal
distances cut the path into pieces of equal work, however long a text or how unlike its two
sides: each piece looks for the offsets both lists hold and knows nothing of the others.
Between two common offsets lies a group; a group that spans pieces is stitched together from
what they emit.  The texts of a batch are laid end to end, as every text ends on a common
offset.

The corpus-wide counts of linked ids are made in two levels.  A lot is a bounded number of
documents in one task: it counts its own pairs, numbers them (often used ones first) and keeps
its documents' pairs as lists of those numbers.  Only the lots' counts are shuffled by pair;
the sums come back to the lot, which settles its documents.  No pair of tokens is a row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.shared import cut
from .bpe_automaton import printable_bytes

#: Merge steps of a piece, and bytes of text encoded at once.
PIECE, CHUNK = 65_536, 1_000_000
#: Pairs of ids, counted per document, and documents that close a lot.
LOT, LOT_DOCUMENTS = 1_000_000, 50_000
#: Links of a group that are spelled out one by one; larger groups are counted by distinct ids first.
SMALL = 64

#: How byte-level vocabularies split text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond Latin, libraries differ in the Unicode version of their letter classes.
UNUSUAL = re.compile("[^\x00-ɏ]")


class Pair:
    """The two tokenizers in a worker: ids and bytes of both."""

    def __init__(self, definition: str, model: bytes):
        self.definition, self.model = definition, model

    @cached_property
    def _json(self) -> dict:
        return json.loads(self.definition)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(self.definition)
        t.encode_special_tokens = True
        t.no_truncation()
        t.no_padding()
        return t

    @cached_property
    def ranked(self):
        """The same merges as ranks, which is far quicker; None where ids don't follow the merges."""
        import tiktoken
        model = self._json["model"]
        vocabulary, special = model["vocab"], {t["content"] for t in self._json["added_tokens"]}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or self._json["normalizer"] or self._json["pre_tokenizer"]["add_prefix_space"]:
            return None
        byte_of = printable_bytes()
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocabulary.items() if s not in special}
        return tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def bytes_a(self) -> list[bytes]:
        byte_of = printable_bytes()
        vocabulary = self._json["model"]["vocab"]
        out = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            if all(c in byte_of for c in s):
                out[i] = bytes(byte_of[c] for c in s)
        return out

    @cached_property
    def pieces(self):
        from sentencepiece import SentencePieceProcessor
        return SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def bytes_b(self) -> list[bytes]:
        def spelled(p: str) -> bytes:
            code = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            return bytes([int(code[1], 16)]) if code else p.replace("▁", " ").encode()
        return [spelled(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        ranked = self.ranked
        plain = [ranked is not None and not UNUSUAL.search(t) for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, ok in zip(texts, plain) if not ok], add_special_tokens=False))
        return [ranked.encode_ordinary(t) if ok else next(rest).ids for t, ok in zip(texts, plain)]

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, list[bytes], int]:
        """Lengths of either side's tokens; printed ids followed by a comma, '|' or ';'; bits of a B id."""
        n = max(len(self.bytes_a), len(self.bytes_b))
        printed = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(n)]
        return (np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b]), printed,
                max(1, (len(self.bytes_b) - 1).bit_length()))


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of `a` the merge path has taken where it crosses each diagonal (a before equal b)."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while np.any(low < high):
        mid = (low + high) // 2
        open_ = low < high
        # a[mid] goes before b[diagonal - mid - 1] exactly if the crossing lies beyond mid
        at = np.clip(diagonals - mid - 1, 0, max(len(b) - 1, 0))
        beyond = a[np.minimum(mid, len(a) - 1)] <= b[at]
        low = np.where(open_ & beyond, mid + 1, low)
        high = np.where(open_ & ~beyond, mid, high)
    return low


def piece(a: np.ndarray, b: np.ndarray, a_from: int, a_to: int, b_from: int, b_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Common offsets (as places in a and in b) whose b lies in the piece; its a is in the
    piece or the last one taken before it."""
    near = max(a_from - 1, 0)
    own = a[near:a_to]
    at = np.searchsorted(own, b[b_from:b_to])
    hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == b[b_from:b_to]) if len(own) else np.zeros(0, np.int64)
    return near + at[hit], b_from + hit


def common_ends(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and in `b` of the offsets both hold, stitched from pieces of `size` merge steps."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, size), total)
    in_a = crossings(a, b, diagonals)
    in_b = diagonals - in_a
    found = [piece(a, b, *cell) for cell in zip(in_a[:-1].tolist(), in_a[1:].tolist(), in_b[:-1].tolist(), in_b[1:].tolist())]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, size)."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def linked(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, group_doc: np.ndarray,
           bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair code, links) of every distinct pair of linked ids of a document."""
    first_a, first_b = np.append(0, end_a[:-1] + 1), np.append(0, end_b[:-1] + 1)
    n_a, n_b = end_a + 1 - first_a, end_b + 1 - first_b
    small = np.flatnonzero(n_a * n_b <= SMALL)
    a_at = _spread(first_a[small], n_a[small])
    each = np.repeat(n_b[small], n_a[small])  # every A token meets the B tokens of its group
    b_at = _spread(np.repeat(first_b[small], n_a[small]), each)
    docs, codes, weights = [np.repeat(group_doc[small], n_a[small] * n_b[small])], [(np.repeat(ids_a[a_at], each) << bits) | ids_b[b_at]], []
    weights.append(np.ones(len(docs[0]), np.int64))
    for g in np.flatnonzero(n_a * n_b > SMALL).tolist():
        x, times_x = np.unique(ids_a[first_a[g]:end_a[g] + 1], return_counts=True)
        y, times_y = np.unique(ids_b[first_b[g]:end_b[g] + 1], return_counts=True)
        codes.append(((x[:, None] << bits) | y[None, :]).ravel())
        weights.append((times_x[:, None] * times_y[None, :]).ravel())
        docs.append(np.full(len(codes[-1]), group_doc[g]))
    doc, code, weight = np.concatenate(docs), np.concatenate(codes), np.concatenate(weights)
    width = int(code.max(initial=0)).bit_length()
    fits = int(doc.max(initial=0)).bit_length() + width < 63
    order = np.argsort((doc << width) | code) if fits else np.lexsort((code, doc))
    doc, code, weight = doc[order], code[order], weight[order]
    start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])) if len(doc) else np.zeros(0, bool))
    return doc[start], code[start], np.add.reduceat(weight, start) if len(start) else weight


def printed_groups(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, table: list[bytes]) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: both sides' ids in the order of the groups."""
    n = len(table) // 3
    a, b = ids_a.copy(), ids_b.copy()
    a[end_a] += n
    b[end_b] += 2 * n
    group_a = np.searchsorted(end_a, np.arange(len(a)))
    group_b = np.searchsorted(end_b, np.arange(len(b)))
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.append(0, end_b + 1)[group_a]] = a
    out[np.arange(len(b)) + (end_a + 1)[group_b]] = b
    return b"".join(map(table.__getitem__, out.tolist()))[:-1]


_LOADED: dict[str, Pair] = {}


def loaded(definition: str, model: bytes) -> Pair:
    key = hashlib.sha256(definition.encode() + model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pair(definition, model)
    return _LOADED[key]


def encoded(pair: Pair, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides; ([], []) for a text that is null, empty, or spelled otherwise by either."""
    full = [t or "" for t in texts]
    at = [i for i, t in enumerate(full) if t]
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(full)
    some = [full[i] for i in at]
    for i, t, a, b in zip(at, some, pair.encode_a([" " + t for t in some]), pair.pieces.encode(some, num_threads=1) if some else []):
        want = b" " + t.encode()
        if b"".join(map(pair.bytes_a.__getitem__, a)) == want and b"".join(map(pair.bytes_b.__getitem__, b)) == want:
            out[i] = (a, b)
    return out


class Aligned:
    """Alignment of a batch of texts: figures of each, groups, and pairs of linked ids."""

    def __init__(self, pair: Pair, texts: list[str | None], piece_size: int = PIECE):
        length_a, length_b, table, bits = pair.tables
        ids = encoded(pair, texts)
        self.n_a, self.n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
        a, b = (np.fromiter((i for x in ids for i in x[side]), np.int64, int(n.sum())) for side, n in ((0, self.n_a), (1, self.n_b)))
        self.ends_a, self.ends_b = common_ends(np.cumsum(length_a[a]), np.cumsum(length_b[b]), piece_size)
        doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        group_doc = doc_of_a[self.ends_a]
        self.n_groups = np.bincount(group_doc, minlength=len(texts))
        sizes = np.diff(self.ends_a, prepend=-1) * np.diff(self.ends_b, prepend=-1)
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, group_doc, sizes)
        self.doc, self.code, self.links = linked(a, b, self.ends_a, self.ends_b, group_doc, bits)
        self.groups = []
        g0 = a0 = b0 = 0
        for n_a, n_b, n_g in zip(self.n_a.tolist(), self.n_b.tolist(), self.n_groups.tolist()):
            part = slice(g0, g0 + n_g)
            self.groups.append(printed_groups(a[a0:a0 + n_a], b[b0:b0 + n_b], self.ends_a[part] - a0, self.ends_b[part] - b0, table) if n_g else b"")
            g0, a0, b0 = g0 + n_g, a0 + n_a, b0 + n_b


# --- lots ----------------------------------------------------------------------------

def packed(values: np.ndarray) -> bytes:
    """Mostly small numbers as eight planes of bytes, which compress to about a byte each."""
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LOT_COLUMNS = "lot long, nth int, a int, b int, n_docs long, pairs binary, links binary"


class Lot:
    """Documents of one task until their pairs are numbered."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.docs, self.pairs = bits, [], 0, 0
        self.doc, self.code, self.links, self.figures = [], [], [], []

    def add(self, keys: pa.Array, done: Aligned) -> None:
        self.keys.append(keys)
        self.figures.append((done.n_a, done.n_b, done.n_groups, done.n_links,
                             [hashlib.sha256(g).hexdigest() if g else "" for g in done.groups]))
        self.doc.append(done.doc + self.docs)
        self.code.append(done.code)
        self.links.append(done.links)
        self.docs += len(done.groups)
        self.pairs += len(done.code)

    @property
    def full(self) -> bool:
        return self.pairs >= LOT or self.docs >= LOT_DOCUMENTS

    def closed(self, number: int) -> tuple[pa.Table, pa.Table]:
        """The lot's pairs, and its documents with their pairs by number."""
        code, at, n = np.unique(np.concatenate(self.code), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(code), np.int64)
        rank[order] = np.arange(len(code))
        code, n = code[order], n[order]
        pairs = pa.table({"lot": np.full(len(code), number), "nth": np.arange(len(code), dtype=np.int32), "a": (code >> self.bits).astype(np.int32),
                          "b": (code & (1 << self.bits) - 1).astype(np.int32), "n_docs": n.astype(np.int64)})
        doc, links, nth = np.concatenate(self.doc), np.concatenate(self.links), rank[at]
        order = np.lexsort((nth, doc))
        doc, links, nth = doc[order], links[order], nth[order]
        ends = np.searchsorted(doc, np.arange(self.docs + 1))
        step = np.diff(nth, prepend=0)
        step[ends[:-1][ends[:-1] < ends[1:]]] = nth[ends[:-1][ends[:-1] < ends[1:]]]
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        columns = [np.concatenate([f[i] for f in self.figures]) for i in range(4)]
        docs = pa.table({"lot": np.full(self.docs, number), "_key": pa.chunked_array(self.keys), "n_a": columns[0], "n_b": columns[1], "n_groups": columns[2],
                         "n_links": columns[3], "groups_sha256": [h for f in self.figures for h in f[4]],
                         "pairs": pa.array([packed(step[i:j]) for i, j in spans], pa.binary()),
                         "links": pa.array([packed(links[i:j]) for i, j in spans], pa.binary())})
        return pairs, docs


def _sources(docs: DataFrame, definition_path: str, model_path: str):
    """Both tokenizers' files, as the workers get them; bounded by the vocabularies."""
    with open(definition_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def _lots(docs: DataFrame, definition_path: str, model_path: str, key: str, text: str) -> DataFrame:
    """Rows of two kinds: the pairs of every lot (nth is not null) and its documents."""
    files = _sources(docs, definition_path, model_path)
    kind = docs.schema[key].dataType.simpleString()
    names = ["_key", *[c.split()[0] for c in f"{FIGURES}, {LOT_COLUMNS}".split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*files.value)
        bits = pair.tables[3]
        number = TaskContext.get().partitionId() << 24
        lot = Lot(bits)

        def emit() -> Iterator[pa.RecordBatch]:
            for t in lot.closed(number):
                for name in names:
                    if name not in t.column_names:
                        t = t.append_column(name, pa.nulls(t.num_rows, schema.field(name).type))
                yield from t.select(names).cast(schema).to_batches(max_chunksize=10_000)

        for batch in batches:
            schema = pa.schema([("_key", batch.column(0).type), *SCHEMA])
            texts = batch.column(1)
            for i, j in _chunks_of(texts):
                lot.add(batch.column(0).slice(i, j - i), Aligned(pair, texts.slice(i, j - i).to_pylist()))
                if lot.full:
                    yield from emit()
                    number, lot = number + 1, Lot(bits)
        if lot.docs:
            yield from emit()

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(work, f"_key {kind}, {FIGURES}, {LOT_COLUMNS}")


SCHEMA = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("lot", pa.int64()),
          ("nth", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("pairs", pa.binary()), ("links", pa.binary())]


def _chunks_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    lengths = np.array([n or 0 for n in pc.utf8_length(texts).to_pylist()])
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        held += n
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def pair_counts(lots: DataFrame) -> DataFrame:
    """(a, b, n_docs, is_best): in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    counts = lots.where("nth is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def align(docs: DataFrame, definition_path: str, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer of `definition_path` (a tokenizer's JSON) over a space and the
    text, B the piece tokenizer of `model_path` over the text.  A null or empty text, and one
    that either tokenizer spells otherwise, has zeros and ''.  A null key stays null; repeated
    rows count as documents of their own; texts of any length are aligned whole; pairs that
    tie for an A id are all best; an empty table gives an empty one.  Other columns are not read,
    whatever their names."""
    lots = cut(_lots(docs, definition_path, model_path, key, text), "lots")
    counts = cut(pair_counts(lots), "pair_counts")
    own = (lots.where("nth is not null").select("lot", "nth", "a", "b").join(counts, ["a", "b"])
           .select(F.col("lot").alias("of_lot"), "nth", "n_docs", "is_best"))
    rows = lots.where("nth is null").select("lot", "_key", *[c.split()[0] for c in FIGURES.split(", ")], "pairs", "links")
    figures = ["n_a", "n_b", "n_groups", "n_links"]

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        nth = right["nth"].to_numpy()
        count[nth] = right["n_docs"].to_numpy()
        best[nth] = right["is_best"].to_numpy().astype(np.int64)
        sums, bests = [], []
        for pairs, links in zip(left["pairs"].to_pylist(), left["links"].to_pylist()):
            at, n = np.cumsum(unpacked(pairs)), unpacked(links)
            sums.append(int(count[at] @ n))
            bests.append(int(best[at] @ n))
        return pa.table([left["_key"], *[left[f] for f in figures], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), left["groups_sha256"]],
                        names=["_key", *figures, "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{f} long" for f in (*figures, "n_best", "count_sum")) + ", groups_sha256 string"
    return (rows.groupBy("lot").cogroup(own.groupBy("of_lot")).applyInArrow(settle, schema)).withColumnRenamed("_key", key)


def token_groups(docs: DataFrame, definition_path: str, model_path: str, text: str = "text") -> DataFrame:
    """`docs` with `groups`: the aligned ids as text, `a1,a2|b1;a3|b2,b3`, '' without tokens."""
    files = _sources(docs, definition_path, model_path)
    fields = [f for f in docs.schema if f.name != "groups"]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*files.value)
        for batch in batches:
            for i, j in _chunks_of(batch.column(text)):
                part = batch.slice(i, j - i)
                done = Aligned(pair, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array([g.decode() for g in done.groups], pa.string())], [*names, "groups"])

    return docs.mapInArrow(work, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "groups string"]))
