"""Byte-level BPE by automaton.

Merges are compiled one after the other into a deterministic automaton over tokens whose
accepted token strings are exactly the right encodings.  It starts with one state and
an arc for every byte.  The gadget of merge (u, v) -> w gives every state that has
a u-arc followed by a v-arc a w-arc into the state behind v, and takes the v-arc away
behind u.  As arcs of one label all lead to one state, the state behind a token is named
by the token, and `Automaton.follows` reads an arc off the gadgets that made it: a w-arc
leaves a state if its u-arc did when w was made; the state behind w starts as a
copy of the one behind v; merge (p, q) takes the q-arc from the state behind p.

Encoding walks a pre-split word byte by byte: the trie's transition table names the tokens
that end at a byte, and the only one with an arc from the state its beginning was left in
gives the next state.  Decoding emits the bytes that label the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kernel

#: How text is split before merging (fixed value of the vocabulary), with the white space class spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words whose encoding a worker remembers; the rest are walked again.
REMEMBERED = 400_000


def printable_bytes() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 bytes stand for themselves,
    the others follow from U+0100 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        byte_of = printable_bytes()
        spelled = {s: bytes(byte_of[c] for c in s) for s in vocabulary}
        self.label = {i: spelled[s] for s, i in vocabulary.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.splitter = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, time of its gadget)
        self.taken: dict[tuple[int, int], int] = {}  # (state, arc) -> time at which a gadget took it
        self.arcs: dict[tuple[int, int], bool] = {}
        self.tokens = {i for s, i in vocabulary.items() if len(s) == 1}
        for time, (u, v) in enumerate(merges):
            self._gadget(vocabulary[u], vocabulary[v], vocabulary[u + v], time)
        self._table()
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if u in self.tokens and v in self.tokens and w not in self.parts and self.follows(u, v, time):
            self.parts[w] = (u, v, time)
            self.tokens.add(w)
            self.taken[u, v] = time

    def follows(self, p: int, q: int, time: int | None = None) -> bool:
        """Whether the state behind p has a q-arc, after all gadgets or those before `time`."""
        end = len(self.label) + len(self.parts) + 1 if time is None else time
        while True:
            if self.taken.get((p, q), end) < end:
                return False
            made_p, made_q = self.parts.get(p, (0, 0, -1)), self.parts.get(q, (0, 0, -1))
            if made_p[2] == made_q[2] == -1:
                return True
            if made_p[2] > made_q[2]:
                p, end = made_p[1], made_p[2]
            elif made_p[2] < made_q[2]:
                q, end = made_q[0], made_q[2] + 1  # a pair of equal tokens is taken before its arc is given
            else:  # p is q: its arc was made while the state behind it was a copy of its right part's
                p, q, end = made_p[1], made_q[0], made_q[2]

    def _table(self) -> None:
        """Transition table over reversed labels: from a byte backwards to the tokens ending there."""
        self.back: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t in sorted(self.tokens):
            at = 0
            for b in reversed(self.label[t]):
                after = self.back[at].get(b)
                if after is None:
                    after = len(self.back)
                    self.back[at][b] = after
                    self.back.append({})
                    self.ends.append(-1)
                at = after
            self.ends[at] = t

    def walk(self, word: bytes) -> tuple[int, ...]:
        """The arcs of the accepting path that spells `word`."""
        back, ends, arcs = self.back, self.ends, self.arcs
        state = [-1]  # behind each prefix; -1: the start, which has every arc
        length = [0]
        for n in range(1, len(word) + 1):
            at, i = 0, n
            while i:
                i -= 1
                at = back[at].get(word[i], 0)
                if not at:
                    raise ValueError("no path spells this word")
                t = ends[at]
                if t < 0:
                    continue
                p = state[i]
                if p >= 0:
                    ok = arcs.get((p, t))
                    if ok is None:
                        if len(arcs) > 4_000_000:
                            arcs.clear()
                        ok = arcs[p, t] = self.follows(p, t)
                    if not ok:
                        continue
                state.append(t)
                length.append(n - i)
                break
            else:
                raise ValueError("no path spells this word")
        out = []
        n = len(word)
        while n:
            out.append(state[n])
            n -= length[n]
        return tuple(reversed(out))

    def pieces(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        """(ids, ids as text) of every pre-split word and special token of `text`."""
        words, at = self.words, 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from self._pieces(text[at:found.start()], words)
            i = self.special[found[0]]
            yield (i,), str(i)
            at = found.end()
        yield from self._pieces(text[at:] if at else text, words)

    def _pieces(self, text: str, words: dict) -> Iterator[tuple[tuple[int, ...], str]]:
        for word in self.splitter.findall(text):
            known = words.get(word)
            if known is None:
                ids = self.walk(word.encode())
                known = (ids, ",".join(map(str, ids)))
                if len(words) < REMEMBERED:
                    words[word] = known
            yield known

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.pieces(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_COMPILED: dict[str, Automaton] = {}


def compiled(definition: str) -> Automaton:
    """The automaton of a tokenizer definition (JSON text); one per worker process."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _COMPILED:
        d = json.loads(definition)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        vocabulary = {s: i for s, i in d["model"]["vocab"].items() if s not in special}
        _COMPILED[key] = Automaton(vocabulary, merges, special)
    return _COMPILED[key]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 (of the ids' decoding).

    `path` names the tokenizer file on the driver; its text goes to the workers, bounded by
    the vocabulary.  Null texts encode as empty ones; repeated rows are encoded one by one;
    other columns are carried along; an empty table gives an empty table."""
    definition = _shared(docs, path)
    drop = {"n_tokens", "ids_sha256", "decoded_sha256"}
    fields = [f for f in docs.schema if f.name not in drop]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = compiled(definition.value)
        counts, ids_hash, decoded_hash = [], [], []
        for content in batch.column(text).to_pylist():
            found = list(automaton.pieces(content or ""))
            ids = [i for piece, _ in found for i in piece]
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join([s for _, s in found]).encode()).hexdigest())
            decoded_hash.append(hashlib.sha256(automaton.decode(ids).encode()).hexdigest())
        names = [f.name for f in fields]
        return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(decoded_hash)],
                                          [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return kernel(docs, work, ", ".join([*schema, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))


def _shared(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())
