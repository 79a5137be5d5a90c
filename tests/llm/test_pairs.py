"""SimHash and embedding near-duplicates against all pairs."""
import math
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stayledger.llm import embedding_dedup as E
from stayledger.llm import simhash as S


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_print(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_spark_has_the_same_hash(spark):
    row = spark.createDataFrame([("some wörds here",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row % 2 ** 64 == xxhash.xxh64_intdigest("some wörds here".encode(), 42)


def test_documents_against_all_pairs(make_docs, corpus):
    got = S.near_duplicates(make_docs(corpus), block=8).collect()
    prints = [(i, brute_print(t, 4)) for i, t, _ in corpus]
    assert sorted((str(r["doc_id"]), r["fingerprint"] % 2 ** 64) for r in got) == sorted((str(i), p) for i, p in prints)
    distinct = sorted({p for _, p in prints})
    root = roots(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(i), least[root[p]]) for i, p in prints)


@pytest.mark.parametrize("max_bits", [0, 3, 4, 7])
@pytest.mark.parametrize("block", [4, 4096])
def test_ring_finds_every_link(spark, max_bits, block):
    rng = np.random.default_rng(max_bits)
    seeds = rng.integers(0, 2 ** 63, 12)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for n in range(10):
            flips = rng.choice(63, max_bits + n % 3, replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in flips))
    found = S.links(spark.createDataFrame([(p,) for p in prints], "fp long"), max_bits, block).collect()
    want = [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= max_bits]
    assert roots(prints, [(r["a"], r["b"]) for r in found]) == roots(prints, want)
    if max_bits:
        assert want


def test_stage_keeps_one_of_each_group(make_docs, corpus):
    docs = make_docs(corpus)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    texts = [r["text"] for r in rows]
    assert set(range(40)) <= set(ids)  # plain documents all stay
    assert not any(i and 100 <= i < 300 for i in ids)  # copies go

    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    def similarity(a, b):
        return len(a & b) / len(a | b)

    sets = [shingles(t) for t in texts]
    assert all(similarity(a, b) < 0.9 for a, b in combinations(sets, 2))
    for i, t, _ in corpus:  # nothing goes without a near-duplicate
        if t not in texts:
            assert max(similarity(shingles(t), s) for s in sets) > 0.6
    assert len(ids) == len(set(ids)) and len(texts) == len(set(texts))
    assert sum(not (t or "").split() for t in texts) == 1
    assert S.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_stage_against_all_pairs(make_docs, block, monkeypatch):
    """Groups around the limit: links are the pairs of similarity 0.8 or more, no others."""
    monkeypatch.setattr(S.verified_links, "__defaults__", (block,))
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(120, 400)))]
        for n in range(5):
            own = list(base)
            for at in rng.choice(len(base), int(len(base) * rng.choice([0.005, 0.015, 0.02, 0.023, 0.026, 0.03, 0.04])), replace=False):
                own[at] = f"e{g}n{n}a{at}"
            rows.append((5 * g + n, " ".join(own), "s"))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in combinations(range(len(rows)), 2) if i // 5 == j // 5}
    assert sum(0.65 < x < 0.8 for x in share.values()) > 100 and sum(0.8 <= x < 0.85 for x in share.values()) > 20
    root = roots(range(len(rows)), [p for p, x in share.items() if x >= 0.8])
    assert sorted(r["doc_id"] for r in S.one_of_each(make_docs(rows)).collect()) == sorted(set(root.values()))


def test_wide_links_split_hot_cells(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 5, dtype=np.uint64)
    rows = []
    for n in range(200):
        p = base.copy()
        p[n % 5] ^= np.uint64(1 << (n % 60))
        rows.append((n, p.tobytes()))
    rows += [(1000 + n, rng.integers(0, 2 ** 63, 5, dtype=np.uint64).tobytes()) for n in range(50)]
    prints = spark.createDataFrame([(n, bytearray(p)) for n, p in rows], "node long, fp binary")
    found = S.wide_links(prints, 320, 54, 24, block=16).collect()
    root = roots([n for n, _ in rows], [(r["a"], r["b"]) for r in found])
    assert {root[n] for n in range(200)} == {0}
    assert all(root[1000 + n] == 1000 + n for n in range(50))


def brute_vectors(rows, threshold):
    good = [(k, np.array(v, float), lab) for k, v, lab in rows if k is not None and lab is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for a, b in combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and
             a[1] @ b[1] / math.sqrt(a[1] @ a[1]) / math.sqrt(b[1] @ b[1]) >= threshold]
    keys = [k for k, _, _ in rows]
    root = roots([k for k in keys if k is not None], links)
    n = {k: 0 for k in keys}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((str(k), n[k], root.get(k), k is not None and root[k] == k) for k in keys)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for g in range(n):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((key, (base + rng.normal(size=32) * rng.choice([0.0, 0.02, 0.08, 0.1])).tolist(), int(g % 3)))
            key += 1
    return rows


def test_a_hot_group_is_no_list_of_pairs():
    """3,000 near copies of one segment: their 4.5 million pairs take 72 MB, a forest needs none of them."""
    rng, n = np.random.default_rng(3), 3000
    base = rng.integers(0, 2 ** 63, 5).astype(np.uint64)
    prints = [(base ^ np.r_[np.uint64(1) << rng.integers(20, 60, 1).astype(np.uint64), np.zeros(4, np.uint64)]).tobytes() for _ in range(n)]
    ring, fp = S._boxes(prints, 6), base[0] ^ (np.uint64(1) << rng.integers(26, 64, n).astype(np.uint64))
    one, own, cross = (np.array([0]), np.array([n])), np.zeros(n, np.int32), np.zeros(n, bool)
    for find in (lambda: S._chained(ring, *one, own, own, cross, 73, 4),
                 lambda: S._ring_pairs(fp, *one, own, cross, 0, S.segments(4), 4)):
        tracemalloc.start()
        a, b = find()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(a) == list(range(1, n)) and not b.any() and peak < 48e6


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_against_all_pairs(spark, block):
    rows = vectors(60)
    hot = np.random.default_rng(1).normal(size=32)
    rows += [(1000 + i, (hot + np.random.default_rng(i).normal(size=32) * 0.01).tolist(), 1) for i in range(40)]
    rows += [(2000 + i, hot.tolist(), 1) for i in range(30)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 32, 1), (3003, hot.tolist(), None), (3004, [None] + hot.tolist()[1:], 1),
             (3005, [float("nan")] + hot.tolist()[1:], 1), (3006, [float("inf")] + hot.tolist()[1:], 1), (None, hot.tolist(), 1),
             (3007, hot.tolist()[:31], 1), (3008, [2.0], 2), (3009, [5.0], 2), (3010, [-5.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    got = E.near_duplicates(df, block=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == brute_vectors(rows, 0.98)


def test_no_vectors(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_index_recall():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98 ** 2) * r
    codes = E.CrossPolytope().buckets(np.concatenate([a, b]))
    i = np.arange(len(a))
    met = E._first_bucket(codes, i, i + len(a)) < np.iinfo(np.int64).max
    assert met.mean() > 0.99
    assert (E._first_bucket(codes, i, np.roll(i, 1)) < np.iinfo(np.int64).max).mean() < 0.01
