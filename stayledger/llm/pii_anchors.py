"""Personal data by anchor expansion.

An Aho-Corasick automaton reads the whole text once and stops at anchors: at-signs, schemes,
cues of identifiers, digits about to form a number.  Around each anchor a small deterministic
parser walks left and right to the value's boundaries and validates it.  Walks of one kind never
go back behind the end of the one before, so a text is read a bounded number of times.

Base kinds follow fixed grammars: the leftmost spans that do not overlap within a kind, dropped
without another try where they fail validation.  The method adds, and never takes away:
addresses with letters beyond ASCII (`wide_email`), addresses that carry a login (`login`),
numbers behind `tel:` (`tel`), and values behind cues: account numbers (`account`; an IBAN is
checked by its remainder) and keys or passwords (`secret`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "wide_email", "login", "tel", "account", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTS, NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]")

#: Cues of identifiers, as anchors.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "social security")
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "access_key", "secret", "password", "passwd")
FILLER = re.compile(r"(?:\s{0,2}(?:number|num|nummer|no|nr|id)\b\.?)?\s{0,2}[:=#]?\s{0,2}[\"']?", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){4,17}(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?")
SECRET = re.compile(r"[^\s\"'<>,;]{8,}")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
LOGIN = re.compile(r"[^\s/?#@\"'<>]+@[^\s/?#@\"'<>]+")
TEL = re.compile(r"[0-9(][\x20().0-9-]*[0-9]")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


class Reader:
    """Parsers over one text.  `done[kind]` is where the next value of a kind may begin."""

    def __init__(self, text: str):
        self.text, self.spans = text, []
        self.done = dict.fromkeys(KINDS, 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))
        self.done[kind] = end

    def back(self, at: int, allowed: Callable[[str], bool], floor: int) -> int:
        """The left end of the run of allowed characters before `at`."""
        text = self.text
        while at > floor and allowed(text[at - 1]):
            at -= 1
        return at

    def at_sign(self, at: int) -> None:
        start = self.back(at, LOCAL.__contains__, self.done["email"])
        host = HOST.match(self.text, at + 1)
        found = host and start < at
        if found:
            self.add("email", start, host.end())
        wide = lambda c: c in LOCAL or (c > "\x7f" and c.isalnum())
        wide_start, wide_host = self.back(at, wide, self.done["wide_email"]), WIDE_HOST.match(self.text, at + 1)
        if wide_host and wide_start < at and not (found and start == wide_start and wide_host.end() == host.end()):
            self.add("wide_email", wide_start, wide_host.end())

    def dotted(self, at: int) -> None:
        """A chain of numbers joined by dots: four at a time are an address."""
        if at < self.done["ip"]:
            return
        start = self.back(at, DIGITS.__contains__, self.done["ip"])
        chain = DOTS.match(self.text, start)
        for found in DOTTED.finditer(self.text, start, chain.end()):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found[0].split("."))):
                self.add("ip", found.start(), found.end())
        self.done["ip"] = chain.end()

    def digits(self, at: int) -> None:
        """A chain of digits, single blanks or hyphens between them."""
        if at < self.done["card"]:
            return
        chain = SPACED.match(self.text, at)
        n = re.sub("[^0-9]", "", chain[0])
        if 12 <= len(n) <= 19 and luhn(n):
            self.add("card", at, chain.end())
        self.done["card"] = chain.end()

    def plus(self, at: int) -> None:
        found = DIALLED.match(self.text, at)
        if found and 9 <= len(NUMBER.findall(found[0])) <= 15:
            self.add("phone", at, found.end())

    def scheme(self, at: int) -> None:
        """`name://user:word@host`: only an address with a login says something of a person."""
        start = self.back(at, SCHEME.__contains__, self.done["login"])
        found = LOGIN.match(self.text, at + 3)
        if found and start < at:
            self.add("login", start, found.end())
        else:
            self.done["login"] = at + 3

    def tel(self, at: int) -> None:
        found = TEL.match(self.text, at + 4)
        if found and 6 <= len(NUMBER.findall(found[0])) <= 15:
            self.add("tel", found.start(), found.end())

    def account(self, at: int, end: int) -> None:
        if self._inside_word(at, end):
            return
        value = FILLER.match(self.text, end).end()
        if value < self.done["account"]:
            return
        number = IBAN.match(self.text, value)
        if number:
            words = number[0].split(" ")  # what follows the number may look like its next group
            for n in range(len(words), 0, -1):
                if iban(" ".join(words[:n])):
                    return self.add("account", value, value + len(" ".join(words[:n])))
        plain = ACCOUNT.match(self.text, value)
        if plain:
            self.add("account", value, plain.end())

    def secret(self, at: int, end: int) -> None:
        if self._inside_word(at, end):
            return
        mark = ASSIGNED.match(self.text, end)
        if not mark or mark.end() < self.done["secret"]:
            return
        found = SECRET.match(self.text, mark.end())
        if found:
            self.add("secret", mark.end(), found.end())

    def _inside_word(self, at: int, end: int) -> bool:
        text = self.text
        return (at > 0 and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum())


def _automaton() -> ahocorasick.Automaton:
    """Anchors -> (parser, offset of the place it starts from the anchor's beginning)."""
    out = ahocorasick.Automaton()
    anchors: dict[str, tuple[str, ...]] = {"@": ("at_sign",), "://": ("scheme",)}
    for a in "0123456789":
        anchors["+" + a] = ("plus",)
        for b in "0123456789":
            anchors[f"{a}.{b}"] = ("dotted",)
            for gap in ("", " ", "-"):
                anchors[f"{a}{gap}{b}"] = ("digits",)
    for names, parser in ((("tel:",), "tel"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for name in names:
            for form in {name, name.upper(), name.capitalize(), name.title()}:
                anchors[form] = (parser,)
    for anchor, (parser,) in anchors.items():
        out.add_word(anchor, (parser, len(anchor)))
    out.make_automaton()
    return out


_AUTOMATON: list[ahocorasick.Automaton] = []


def spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed, then end; offsets in code points."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    reader = Reader(text)
    for last, (parser, size) in _AUTOMATON[0].iter(text):
        at = last - size + 1
        if parser in ("account", "secret"):
            getattr(reader, parser)(at, last + 1)
        else:
            getattr(reader, parser)(at)
    return sorted(set(reader.spans))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `pii`: an array of (kind, start, end, is_base), ordered by start, then kind.

    Null and empty texts have an empty array; texts are read whole; repeated rows are read one
    by one; spans of different kinds may overlap; spans that tie in start follow the order of
    KINDS; other columns are carried along, but for one called `pii`; an empty table gives an
    empty one."""
    fields = [f for f in docs.schema if f.name != "pii"]
    names = [f.name for f in fields]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("is_base", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": i, "end": j, "is_base": KINDS[k] in BASE} for i, k, j in spans(t)]
                     for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.list_(span))], [*names, "pii"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return docs.mapInArrow(work, ", ".join([*schema, "pii array<struct<kind: string, start: bigint, end: bigint, is_base: boolean>>"]))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` of `find` with every found value replaced by its kind in brackets; of values that overlap, the first one names the place."""
    def step(done, s):
        hidden = F.concat(done["text"], F.substring(F.col(text), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        inside = s["start"] < done["at"]
        return F.struct(F.when(inside, done["text"]).otherwise(hidden).alias("text"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    rest = lambda d: F.concat(d["text"], F.substring(F.col(text), (d["at"] + 1).cast("int"), F.length(text)))
    return docs.withColumn(text, F.when(F.size("pii") > 0, F.aggregate("pii", start, step, rest)).otherwise(F.col(text)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    def joined(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["is_base"])
    counts = [F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
