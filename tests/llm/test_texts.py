"""Source mix, quality rules, line dedup and BPE against brute force."""
import hashlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayledger.llm import bpe_automaton as B
from stayledger.llm import line_frequency as Q
from stayledger.llm import line_runs as R
from stayledger.llm import source_mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


# --- mix

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * each > most * sizes[s]]
        if not full:
            return target | {s: weight[s] * each for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("stretch", [3, 2_000])
def test_mix_against_brute_force(make_docs, corpus, stretch):
    got = M.mix(make_docs(corpus), stretch=stretch).collect()
    size = defaultdict(int)
    by = defaultdict(list)
    for i, t, s in corpus:
        size[s] += len(words(t))
        by[s].append((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, len(words(t)), i))
    target = brute_targets(size)
    want = []
    for s, rows in by.items():
        left = int(target[s])
        epochs = left // size[s] if size[s] else 0
        left -= epochs * size[s]
        for *_, n, i in sorted(rows):
            want.append((str(i), str(s), n, epochs * n + min(n, left)))
            left -= min(n, left)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in got) == sorted(want)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * r["size"]


def test_mix_of_nothing(make_docs):
    assert M.mix(make_docs([])).count() == 0
    rows = M.mix(make_docs([(1, None, "a"), (2, "", "b")])).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0)] * 2


def test_mixed_texts_have_the_words_taken(make_docs, corpus):
    docs = make_docs(corpus)
    out = M.mixed(docs.where("doc_id <> 3"))
    assert out.columns == docs.columns
    target = {r["source"]: r["target"] for r in M.mix(docs.where("doc_id <> 3")).collect()}
    by = {(i, t) for i, t, _ in corpus}
    got, cut = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r["source"]] += len(words(r["text"]))
        assert any(i == r["doc_id"] and (t or "").startswith(r["text"]) for i, t in by)
        cut[r["source"]] += (r["doc_id"], r["text"]) not in by
    assert {s: n for s, n in got.items() if n} == {s: int(t) for s, t in target.items() if int(t)}
    assert max(cut.values()) == 1  # only the document that crosses the budget


# --- quality rules

def brute_quality(rows, most, percent, share):
    lines = [[" ".join(words(lower(x))) for x in (t or "").split("\n")] for _, t, _ in rows]
    seen, there = defaultdict(set), defaultdict(set)
    for own, (_, _, host) in zip(lines, rows):
        whole = tuple(x for x in own if x)
        there[host].add(whole)
        for x in whole:
            seen[host, x].add(whole)
    out, poor = [], defaultdict(list)
    for own, (i, t, host) in zip(lines, rows):
        t = t or ""
        w = words(t)
        grams = defaultdict(list)
        for k in range(len(w) - 7):
            grams[tuple(w[k:k + 8])].append(k)
        twice = {p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        plain = [x for x in t.split("\n") if words(x)]
        often = [x for x in own if x and len(seen[host, x]) > most and 100 * len(seen[host, x]) > share * len(there[host])]
        common = sum(len(x.split(" ")) for x in often)
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        if not failed and 100 * (len(w) - common) < percent * len(w):
            poor[host, frozenset(often)].append((i is None, i or 0, len(out)))
        out.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(plain) - len(set(plain)), len(twice), failed, common,
                    not failed and 100 * (len(w) - common) >= percent * len(w)))
    for group in poor.values():
        for null, i, at in group:
            if (null, i) == min(group)[:2]:
                out[at] = (*out[at][:-1], True)
    return sorted(out)


@pytest.mark.parametrize("most,percent,share", [(2, 60, 2), (1, 99, 15), (10, 20, 2)])
def test_quality_against_brute_force(make_docs, corpus, most, percent, share):
    rows = [*corpus, (500, "a b # | c d e f g h\n" * 9, "s1"), (501, " ".join(str(i % 30) for i in range(100)), "s1")]
    got = Q.quality(make_docs(rows), most, percent, share_percent=share)
    want = brute_quality(rows, most, percent, share)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns[1:])) for r in got.collect()) == want
    assert Q.quality(make_docs([])).count() == 0


def test_copies_do_not_make_lines_common(make_docs, corpus):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(5))
    assert Q.quality(make_docs([(i, text.upper() if i % 2 else text, "h") for i in range(50)]), 10, 20).where("kept").count() == 50
    near = make_docs([(i, text + f"\nown {i}", "h") for i in range(50)])  # which differ: one stays for all
    assert [r["doc_id"] for r in Q.quality(near, 10, 20).where("kept").collect()] == [0]


def test_verdicts_do_not_depend_on_the_size_of_a_mix(make_docs):
    def mix(times):
        rows = []
        for i in range(600 * times):
            body = " ".join(f"w{i}x{j}" for j in range(30))
            head = "printed on every page" if i % 3 == 0 else "now and then a line" if i % 80 == 1 else f"own {i}"
            rows.append((i, f"{head}\n{body}", "big"))
        return {r["doc_id"]: (r["n_common_words"], r["kept"]) for r in Q.quality(make_docs(rows)).collect()}

    one, ten = mix(1), mix(10)
    assert {i: ten[i] for i in one} == one and {n for n, _ in one.values()} == {0, 4}


def test_clean_strips_common_lines(make_docs):
    rows = [(i, f"common line here\n{' '.join(f'w{i}x{j}' for j in range(30))}", "h") for i in range(15)]
    docs = make_docs([*rows, (99, "too short", "h"), (98, None, "h")])
    out = Q.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(i, t.split("\n")[1]) for i, t, _ in rows]


def test_clean_counts_documents_with_a_long_shared_line(make_docs):
    notice = " ".join(f"notice{j}" for j in range(60))  # longer than any other line of its documents
    rows = [(i, f"{notice}\n{' '.join(f'w{i}x{j}' for j in range(30))}", "h") for i in range(15)]
    out = Q.clean(make_docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(i, t.split("\n")[1]) for i, t, _ in rows]
    copies = [(i, rows[0][1].upper(), "h") for i in range(30)]
    assert sorted(r["text"] for r in Q.clean(make_docs(copies)).collect()) == sorted(t for _, t, _ in copies)


def test_clean_keeps_one_of_a_group_edited_in_its_longest_line(make_docs):
    shared = "\n".join(" ".join(f"s{i}x{j}" for j in range(20)) for i in range(8))
    rows = [(i, f"{shared}\n{' '.join(f'long{j}' for j in range(25))} edit{i}", "h") for i in range(15)]
    rows += [(100, " ".join(f"own{j}" for j in range(30)), "h")]
    assert sorted((r["doc_id"], r["text"]) for r in Q.clean(make_docs(rows)).collect()) == [rows[0][:2], rows[-1][:2]]


# --- line dedup

def brute_runs(rows, least):
    """Texts without later copies; documents in the order of key (null last) and hash of the text."""
    docs = [([(n, x) for n, x in enumerate(t.split("\n")) if words(x)], t) for _, t in rows]
    out = []
    for d, (own, t) in enumerate(docs):
        gone = set()
        for j in range(len(own)):
            best = 0
            for e in range(d + 1):
                other = docs[e][0]
                for k in range(j if e == d else len(other)):
                    n = 0
                    while j + n < len(own) and k + n < len(other) and own[j + n][1] == other[k + n][1]:
                        n += 1
                    best = max(best, n)
            if best and sum(len(words(x)) for _, x in own[j:j + best]) >= least:
                gone |= {n for n, _ in own[j:j + best]}
        out.append("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    return out


@pytest.mark.parametrize("seed,least", [(0, 3), (1, 6), (2, 12), (3, 50)])
def test_line_runs_against_brute_force(make_docs, seed, least):
    import random
    rng = random.Random(seed)
    lines = ["a", "b c", "d e f", "", "g h i j", "k", "l m n o p q"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25))) for _ in range(20)]
    texts += [texts[3], texts[3] + "\n" + texts[4], "x y z\n" * 12, "\n".join([texts[5], "mid", texts[5]])]
    rows = list(enumerate(texts))
    docs = make_docs([(i, t, "s") for i, t in rows])
    got = {r["doc_id"]: r["text"] for r in R.without_repeats(docs, least).collect()}
    assert [got[i] for i, _ in rows] == brute_runs(rows, least)


def test_line_runs_edges(make_docs, corpus):
    docs = make_docs(corpus)
    out = R.without_repeats(docs, 20)
    assert out.columns == [*docs.columns, "n_removed"]
    rows = out.collect()
    assert len(rows) == len(corpus)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[400][0]["text"] is None and by[401][0]["text"] == "" and by[402][0]["text"] == " \n\t "
    assert len(by[3]) == 3 and all(r["n_removed"] == 0 for r in by[3])  # rows of one key and text are one document
    assert all(not words(by[100 + i][0]["text"]) for i in range(12) if len(words(corpus[i % 4][1])) >= 20)
    assert by[404][0]["n_removed"] == 0
    assert R.without_repeats(make_docs([])).count() == 0


def test_ranks_are_those_of_a_suffix_array(spark, make_docs):
    text = "\n".join("b a n a n a b a n a q".split())
    levels = R.doubled(R.repeated_lines(make_docs([(1, text, "s")]), "doc_id", "text"))
    assert [t.count() for t in levels][:3] == [10, 8, 2]
    first = {r["seq"]: r["rank"] for r in levels[0].collect()}
    for k, level in enumerate(levels):
        rank = {r["seq"]: r["rank"] for r in level.collect()}
        keys = {i: tuple(first.get(i + j, -1) for j in range(1 << k)) for i in rank}
        for i in rank:
            for j in rank:
                assert (rank[i] < rank[j]) == (keys[i] < keys[j])


# --- BPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "a\x1cb \x85 c", "  \n\n x  <|endoftext|> y<|endoftext|>", "I'll don't  naïve Ⅷ ½ १२ 漢字 🎉🎉 zero", "a" * 500 + "\t\t\t   ", "　  x",
        "*" * 37 + "=" * 101 + "-" * 64, "!!!???###" * 9, "0" * 301, "é́ 'S 'LL 'Re", "\r\n\r\n \r", "<|endoftext|", "ẞ​﻿\U0010ffff"]


def test_automaton_against_the_library(corpus):
    own, other = B.compiled(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    for t in [*HARD, *(t for _, t, _ in corpus if t)]:
        ids = other.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False) == t


def test_arcs_accept_right_encodings_only():
    own, other = B.compiled(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    import random
    rng = random.Random(1)
    tokens = [t for t in rng.sample(sorted(own.tokens), 3000) if own.label[t].isalpha() and own.label[t].isascii()]
    seen = set()
    for a, b in zip(tokens, tokens[1:]):
        right = other.encode((own.label[a] + own.label[b]).decode(), add_special_tokens=False).ids == [a, b]
        assert own.follows(a, b) == right
        seen.add(right)
    assert seen == {True, False}


def test_encode_table(make_docs, corpus):
    rows = [*corpus, *((600 + i, t, "s") for i, t in enumerate(HARD))]
    other = Tokenizer.from_file(PATH)
    got = B.encode(make_docs(rows).withColumn("n_tokens", F.lit("clash")), PATH)
    ids = [other.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(r[0]), len(i), sha(",".join(map(str, i))), sha(r[1] or "")) for r, i in zip(rows, ids))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    assert B.encode(make_docs([]), PATH).count() == 0
