"""Token alignment, personal data and ranked search against brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stayledger.llm import dual_tree as D
from stayledger.llm import pii_anchors as P
from stayledger.llm import token_alignment as A

DEFINITION, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")



# --- op13: ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    found = [(i, brute_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in sorted(set(items), key=str):
        asked, scored = Counter(brute_terms(text)), []
        for i, ts in found:
            tf = Counter(ts)
            m = 75 + (25 * len(ts) * n_docs) // max(n_terms, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 12 * m))
                        for t, c in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                                                     T.StructField("key", T.StringType())]))


@pytest.mark.parametrize("block_terms,k", [(200_000, 20), (60, 3)])
def test_search_against_brute_force(spark, make_docs, corpus, block_terms, k):
    rng = random.Random(3)
    vocab = sorted({w for _, t, _ in corpus for w in brute_terms(t)})
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12))), "x") for i in range(30)]
    rows += [(30, None, "x"), (31, "", "x"), (32, "none of these zzzzz", "x"), (33, vocab[0].upper() + " É é " + vocab[0], "x"), rows[2], (None, vocab[3], "x")]
    got = D.search(make_docs(corpus), items_of(spark, rows), k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search([(i, t) for i, t, _ in corpus], [(i, t) for i, t, _ in rows], k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_search_of_empty_tables(spark, make_docs, corpus):
    assert D.search(make_docs([]), items_of(spark, [(1, "a b", "x")])).collect() == []
    assert D.search(make_docs(corpus), items_of(spark, [])).collect() == []
    assert D.search(make_docs([(1, None, "s"), (2, "", "s")]), items_of(spark, [(1, "a b", "x")])).collect() == []


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    n_docs, width, k = 3_000, 400, 5
    rows = [(i, [b"%d" % t for t in rng.zipf(1.3, 12) % width]) for i in range(90)]
    block = D.Block.of(rows + [(90, [b"%d" % t for t in range(width)])])
    weight = rng.integers(1, 9_000, width)
    counts = rng.integers(0, 15, n_docs)
    term = np.concatenate([np.sort(rng.choice(width, c, replace=False)) for c in counts])
    value = weight[term] * rng.integers(1, 1_000, len(term))
    tree = D.ItemTree(block, weight, np.float64)
    search = D.Search(tree, np.zeros(len(tree.number)), k)
    for part in np.array_split(np.arange(n_docs), 2):
        mine = np.isin(np.repeat(np.arange(n_docs), counts), part)
        search.over(D.Stretch(part, np.ones(len(part), bool), counts[part], term[mine], value[mine], width, np.float64))
    dense = np.zeros((n_docs, width), np.int64)
    dense[np.repeat(np.arange(n_docs), counts), term] = value
    number, score, key, _ = search.rows()
    for i, (t, n) in zip(block.number, block.asked):
        scores = dense[:, t] @ n
        best = [d for d in np.lexsort((np.arange(n_docs), -scores))[:k] if scores[d] > 0]
        assert key[number == i].tolist() == best and score[number == i].tolist() == scores[best].tolist()
    assert search.visited < 0.7 * search.pairs


# --- op12: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in re.findall("[0-9]", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def base_of(text):
    return [s for s in P.spans(text) if P.KINDS[s[1]] in P.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@abZ_%é\n:/tel", max_size=60) | st.text(alphabet="41 -", max_size=40) | st.text(alphabet="12.", max_size=30)
       | st.text(alphabet="a@.-", max_size=30) | st.text(alphabet="+12 (.)", max_size=40))
def test_base_spans_are_those_of_the_grammars(text):
    assert base_of(text) == brute_spans(text)


def test_base_spans_of_known_values():
    text = "Ünal: me.x+1@mail5.example.com, 4111 1111-1111 1111; 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 010-9999. a@b@c.d +1234567890123456"
    assert base_of(text) == brute_spans(text)
    assert Counter(P.KINDS[k] for _, k, _ in base_of(text)) == {"email": 2, "card": 1, "ip": 3, "phone": 1}
    assert base_of("9" * 100_000) == [] and base_of("a" * 100_000 + "@b.c") == [(0, 0, 100_004)]


@pytest.mark.parametrize("text,found", [
    ("IBAN: DE89 3704 0044 0532 0130 00 or", ("account", "DE89 3704 0044 0532 0130 00")),
    ("iban DE88370400440532013000", None), ("account no. 12345678 is", ("account", "12345678")), ("an accountant 12345678", None),
    ('token = "24be64439e3e49cf"', ("secret", "24be64439e3e49cf")), ("a token of thanks", None), ("ftp://me:word@host.example/x", ("login", "ftp://me:word@host.example")),
    ("see https://host.example/a@b", None), ("tel:555-0100", ("tel", "555-0100")), ("müller@exämple.org", ("wide_email", "müller@exämple.org"))])
def test_spans_the_method_adds(text, found):
    more = [(P.KINDS[k], text[i:j]) for i, k, j in P.spans(text) if P.KINDS[k] not in P.BASE]
    assert more == ([found] if found else [])


def test_find_digest_and_redaction(make_docs):
    text = "write to a.b@c.de or +1 (555) 010-9999, 10.1.1.1"
    rows = [(1, text, "s"), (2, None, "s"), (3, "", "s"), (None, "clean", None), (1, text, "s")]
    found = P.find(make_docs(rows))
    spans = ",".join(f"{list(BASE)[k]}:{i}:{j}" for i, k, j in brute_spans(text))
    digest = P.digest(found)
    assert digest.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = sorted(digest.collect(), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    want = [(1, 1, 1, 0, 1, hashlib.sha256(spans.encode()).hexdigest(), spans)] * 2 + [(i, 0, 0, 0, 0, empty, "") for i in (2, 3, None)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]}")
    texts = {r.doc_id: r.text for r in P.redacted(found).collect()}
    assert texts == {1: "write to [email] or [phone], [ip]", 2: None, 3: "", None: "clean"}
    assert P.find(make_docs([])).collect() == []


# --- op11: token alignment

def brute_alignment(texts):
    """Per text: (a ids, b ids, groups of ids), [] where the bytes differ."""
    t = Tokenizer.from_file(DEFINITION)
    t.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=MODEL)
    table = A.printable_bytes()
    out = []
    for text in texts:
        want = b" " + (text or "").encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        wa = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
        wb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if b"".join(wa) != want or b"".join(wb) != want:
            out.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in wa]).tolist(), np.cumsum([len(x) for x in wb]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        out.append(groups)
    return out


def brute_rows(rows):
    found = brute_alignment([t for _, t in rows])
    held = defaultdict(int)
    for groups in found:
        for pair in {(x, y) for a, b in groups for x in a for y in b}:
            held[pair] += 1
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), groups in zip(rows, found):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links),
                    sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = ["<|endoftext|> and </s>", "a\u2581b", "日本語のテキスト、いろいろ", "x" * 997 + " " + "ab" * 301, " \t\n  two  ", "👩‍👩‍👧 ﬁ ½ Ⅳ\u0301", "ẞ\u00a0\u0085\u2028ǅ", "tab\tend\r\n"]


@pytest.mark.parametrize("lot", [A.LOT, 500])
def test_alignment_against_brute_force(spark, make_docs, corpus, monkeypatch, lot):
    monkeypatch.setattr(A, "LOT", lot)
    rows = [(i, t[:3_000] if t else t, s) for i, t, s in corpus] + [(500 + i, t, "odd") for i, t in enumerate(ODD)]
    got = A.align(make_docs(rows), DEFINITION, MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_rows([(i, t) for i, t, _ in rows]), key=str)


def test_groups_are_printed(make_docs):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, None, ""])]
    got = {r.doc_id: r.groups for r in A.token_groups(make_docs(rows), DEFINITION, MODEL).collect()}
    want = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for g in brute_alignment([t for _, t, _ in rows])]
    assert [got[i] for i in range(len(rows))] == want
    assert A.align(make_docs([]), DEFINITION, MODEL).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 20))
def test_pieces_of_any_size_find_all_common_ends(a, b, size):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    at_a, at_b = A.common_ends(a, b, size)
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[at_a].tolist() == both and b[at_b].tolist() == both


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=40), min_size=1, max_size=5) | st.lists(st.text(alphabet="abc de\u00a0\u0085'ß", min_size=1, max_size=60), min_size=1, max_size=5))
def test_ranks_and_merges_agree(texts):
    pair = A.loaded(open(DEFINITION, encoding="utf-8").read(), open(MODEL, "rb").read())
    assert pair.ranked is not None
    assert pair.encode_a(texts) == [e.ids for e in pair.library.encode_batch(texts, add_special_tokens=False)]
