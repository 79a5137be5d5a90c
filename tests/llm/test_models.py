"""LM scoring, toxicity, ordinal quality and HTML wrappers."""
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stayledger.llm import html_wrapper as H
from stayledger.llm import masked_lm as L
from stayledger.llm import ordinal_quality as O
from stayledger.llm import toxicity as X

SMALL = L.Shape(classes=8, members=8, hashed=16, width=6, batch=64)


def test_lots_are_sorted_by_one_whole_number(spark, make_docs):
    """Spark sorts one long by radix; of two keys every pair of a lot's rows is compared in full."""
    docs = make_docs([(n, f"a b c rare{n} rarer{n % 3}", "s") for n in range(40)])
    scores = L.score(docs, L.fit(docs, SMALL))
    last = re.search(r"Sort \[(.*)\], false", scores._jdf.queryExecution().sparkPlan().toString()).group(1)
    assert last.count("NULLS FIRST") == 1 and "shiftleft(lot" in last
    assert sorted(r["doc_id"] for r in scores.collect()) == list(range(40))


def test_no_list_travels_with_the_shares(spark, make_docs):
    """Spark measures a batch after every row it adds, which takes long for a column of lists."""
    docs = make_docs([(n, f"a b c rare{n} rarer{n % 3}", "s") for n in range(40)])
    plan = L.score(docs, L.fit(docs, SMALL))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    sent = plan.children().head().schema().simpleString()
    assert "rare:binary" in sent and "array" not in sent


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shape = L.Shape(classes=3, members=3, hashed=2, width=4)
    ids = np.r_[9, 9, rng.integers(0, 9, 12), 9, 9, rng.integers(0, 9, 5), 9, 9].astype(np.int32)
    net = L.Network(shape, rng.normal(size=L.Network.size(shape)) * 0.3)  # in double precision
    real = (ids[2:-2] < 9).sum()

    def loss(flat):
        return -L.Network(shape, flat).log_prob(ids).sum() / (len(ids) - 4)

    moved = {}
    net._step = lambda name, grad, squares: moved.__setitem__(name, np.array(grad, float))
    net.train(ids, None)
    grads = L.Network(shape, np.zeros(len(net.flat)))
    for name, g in moved.items():
        getattr(grads, name)[...] = g
    for at in rng.choice(len(net.flat), 60, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert grads.flat[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-6)
    assert real == 17


def test_conditionals_sum_to_one():
    shape = SMALL
    net = L.Network.start(shape, np.arange(shape.entries, dtype=float))
    around = [3, 9, None, 20, 1]
    total = 0.0
    for w in range(shape.entries):
        ids = np.array([around[0], around[1], w, around[3], around[4]], np.int32)
        total += math.exp(net.log_prob(ids)[0])
    assert total == pytest.approx(1.0, abs=1e-4)


def text_of(rng, n):
    """Words that both neighbours tell: a b c a b c ... with now and then another word."""
    return " ".join("abc"[i % 3] * 2 if rng.random() < 0.95 else rng.choice("xyz") for i in range(n))


def test_scores(make_docs):
    rng = random.Random(3)
    rows = [(i, text_of(rng, 200), "s") for i in range(60)]
    rows += [(100, " ".join(sorted(text_of(rng, 200).split())), "s"), (101, None, "s"), (102, "", "s"), (None, "aa BB cc", "s"), (103, text_of(rng, 30_000), "s"),
             rows[0]]
    docs = make_docs(rows)
    model = L.fit(docs, SMALL)
    got = {}
    for r in L.score(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[0]) == 2 and got[0][0]["log_prob"] == pytest.approx(got[0][1]["log_prob"], abs=1e-3)
    assert got[101][0]["n_tokens"] == 0 and got[101][0]["log_prob"] == 0 and got[102][0]["mean_log_prob"] is None
    assert got[103][0]["n_tokens"] == 30_000 and got[None][0]["n_tokens"] == 3
    ordered, shuffled = np.mean([got[i][0]["mean_log_prob"] for i in range(60)]), got[100][0]["mean_log_prob"]
    assert ordered > -0.9 and ordered > shuffled + 0.5
    net, vocabulary = L.Network(model.shape, model.flat), L.Vocabulary(model.words, model.shape)
    for i in (5, None):
        words = next(t for k, t, _ in rows if k == i).lower().encode().split()
        ids = np.array([64, 64, *map(vocabulary.__getitem__, words), 64, 64], np.int32)
        assert got[i][0]["log_prob"] == pytest.approx(net.log_prob(ids).sum(), rel=1e-4)
    again = L.fit(docs.repartition(3, "doc_id"), SMALL)
    assert again.words == model.words
    assert np.array_equal(L.fit(docs, SMALL).flat, model.flat)


def test_rare_words_have_their_own_probability(make_docs):
    frequent = " ".join(f"f{i} " * 40 for i in range(SMALL.frequent))
    rare = " ".join(f"r{i} " * (1 + i % 12) for i in range(600))
    docs = make_docs([(1, frequent, "s"), (2, rare, "s")])
    model = L.fit(docs, SMALL)
    share = {bytes(r["word"]): math.exp(r["log_share"]) for r in model.rare.collect()}
    assert len(share) == 600
    total = [math.exp(x) for x in model.unseen]
    for w, p in share.items():
        total[zlib.crc32(w) % SMALL.hashed] += p
    assert total == pytest.approx([1.0] * SMALL.hashed)
    often, once = (next(w for w in (f"r{i}" for i in range(n, 600, 12)) if zlib.crc32(w.encode()) % SMALL.hashed == 3) for n in (11, 0))
    unseen = next(w for w in (f"q{i}" for i in range(999)) if zlib.crc32(w.encode()) % SMALL.hashed == 3)
    got = {r["doc_id"]: r["log_prob"] for r in L.score(make_docs([(n, w, "s") for n, w in enumerate((often, once, unseen))]), model).collect()}
    assert got[0] - got[1] == pytest.approx(math.log(12), abs=1e-3) and got[1] - got[2] > 5


def test_scores_against_plain_loops(make_docs):
    """Sums over dictionaries and lists, with counts of its own, in three partitionings."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice(["", "", "\n", "X"]) for _ in range(rng.randint(0, 90))), "s") for i in range(80)]
    rows += [(500, None, "s"), (501, " \t ", "s"), (502, "never", "s"), (503, "É ÉX é", "s")]
    docs = make_docs(rows[:-2])
    model = L.fit(docs, SMALL)
    counts, width, side = {}, SMALL.width, SMALL.classes
    for _, text, _ in rows[:-2]:
        for w in (text or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:SMALL.frequent]
    assert [w.decode() for w in model.words] == ranked

    def entry(w):
        return ranked.index(w) if w in ranked else SMALL.frequent + zlib.crc32(w.encode()) % SMALL.hashed

    whole = {}
    for w in counts:
        if w not in ranked:
            n, kinds = whole.get(entry(w), (0, 0))
            whole[entry(w)] = n + counts[w], kinds + 1
    net = L.Network(SMALL, model.flat.astype(float))

    def plain(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        ids, total = [64, 64, *map(entry, words), 64, 64], 0.0
        for i, w in enumerate(words, 2):
            h = [math.tanh(net.b[x] + sum(net.E[ids[i + k]][j * width + x] for j, k in enumerate((-2, -1, 1, 2)))) for x in range(width)]
            c, m = divmod(ids[i], side)
            of_class = [net.bc[j] + sum(h[x] * net.Wc[x][j] for x in range(width)) for j in range(side)]
            member = [net.B[c][j] + sum(h[x] * net.U[x][j] for x in range(width)) for j in range(side)]
            total += of_class[c] - math.log(sum(map(math.exp, of_class))) + member[m] - math.log(sum(map(math.exp, member)))
            if w not in ranked:
                n, kinds = whole.get(ids[i], (0, 0))
                total += math.log(counts[w] / (n + kinds + 1)) if w in counts else math.log((kinds + 1) / (n + kinds + 1)) - (len(w.encode()) + 1) * math.log(257)
        return total

    want = {i: plain(text) for i, text, _ in rows}
    for parts in (1, 4, 30):
        got = {r["doc_id"]: r["log_prob"] for r in L.score(make_docs(rows).repartition(parts), model).collect()}
        assert got == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_entries_grow_with_the_words():
    assert [L.Shape.of(n).entries for n in (0, 1_000_000, 1_100_000, 4_000_000, 10**9)] == [1024, 1024, 2048, 2048, 32768]
    assert all(s.hashed * 4 == s.entries for s in map(L.Shape.of, (0, 10**6, 10**8)))


def test_scores_of_nothing(make_docs):
    docs = make_docs([])
    assert L.score(docs, L.fit(docs, SMALL)).count() == 0


def labelled(spark, n=400):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["grubface", "snotling", "wretchard", "ploomer"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(15, 80))]
        toxic, poor = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        text = " ".join(w + "###" if poor else w for w in words)
        docs.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(9000, None), (9001, ""), (None, "some words"), (9002, " ".join(vocab) * 60), docs[0]]
    labels += [(None, 1, 1), (9001, None, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("toxic", F.lit("t")),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels})


def out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    docs, labels, known = labelled(spark)
    how = X.Fit(part=6_000)
    model = X.fit(docs, labels, how)
    rows = X.score(docs, model).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == out(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and known.get(r["doc_id"], (None, None))[1] is not None and r["doc_id"] is not None]
    assert len(held) > 60
    right = [r["predicted"] == known[r["doc_id"]][1] for r in held]
    assert np.mean(right) > 0.95
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(X.fit(docs, wrong, how).weights, model.weights)  # held-out labels aren't read


def test_toxic_phrases_of_ordinary_words(spark):
    """Every word is as frequent in either kind of text; only four of them in a row tell."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(4, 9))) for _ in range(200)]
    phrases = [vocab[i:i + 4] for i in range(0, 24, 4)]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = [rng.choice(vocab) for _ in range(rng.randint(30, 60))], i % 3 == 0
        for phrase in rng.sample(phrases, 2):
            at = rng.randrange(len(words))
            if toxic:
                words[at:at] = phrase
            else:
                for w in phrase:
                    words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, rated = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in X.score(docs, X.fit(docs, rated)).collect() if r["held_out"]]
    assert np.mean([p for p, t in held if t]) > 0.9 and np.mean([1 - p for p, t in held if not t]) > 0.95


def test_toxicity_windows_against_plain_slices():
    """Lengths of all windows by compressors of their own, one for each window."""
    rng = random.Random(6)
    vocab = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    shared, own, other = (b"".join(map(X.coded, vocab[a:b])) for a, b in ((0, 200), (200, 250), (250, 300)))
    model = X.Model(other + shared, own + shared, X.Fit(), np.zeros(X.FEATURES))
    search = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=19, search_log=5, min_match=5, target_length=64,
                                                 strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(window, content):
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=search, dict_data=given).compress(window))

    def plain(window):
        return length(window, model.ordinary) - length(window, model.toxic)

    for n in (0, 1, 2, 15, 16, 17, 28, 29, 80):
        text = [rng.choice(vocab) for _ in range(n)]
        starts = [] if n < 2 else [0] if n <= 16 else sorted({*range(0, n - 16, 12), n - 16})
        pairs = [zlib.crc32(a + b" " + b).to_bytes(4, "big") + zlib.crc32((a + b" " + b)[::-1]).to_bytes(4, "big") for a, b in zip(text, text[1:])]
        far = X.Distance(model)
        spans = far.spans(text)
        assert spans == [plain(b"".join(pairs[i:i + 15])) for i in starts]
        assert all(any(i <= j and j + 4 <= i + 16 for i in starts) for j in range(n - 3))  # no run of four words is cut everywhere
        singles = {w: plain(X.coded(w)) for w in text}
        assert all(far(w) == d for w, d in singles.items())
        assert all(d == 0 for w, d in singles.items() if w in vocab[:200] and w not in vocab[200:] and len(w) > 3)
        got = far.features(b" ".join(text))
        assert got[1] == np.log1p(sum(singles[w] >= 4 for w in text)) and got[8:10] == [np.log1p(sum(d >= k for d in spans)) for k in (5, 10)]


def test_toxicity_compresses_only_windows_that_can_gain():
    """Gains are the distances above 0, at a tenth of the compressions; own pairs and words of the toxic part are all found."""
    rng = random.Random(7)
    vocab = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 12))) for _ in range(400)]
    phrases = [vocab[i:i + 4] for i in range(0, 24, 4)]
    pairs = lambda runs: b"".join(b"".join(X.paired(r)) for r in runs)
    shared = b"".join(map(X.coded, vocab[40:300]))
    model = X.Model(pairs([vocab[i:i + 2] for i in range(100, 300, 2)]) + shared, b"".join(map(X.coded, vocab[380:])) + pairs(phrases) + shared, X.Fit(), np.zeros(X.FEATURES))
    all_of, some_of, called = X.Distance(model), X.Distance(model), Counter()

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def compress(self, window):
            called["n"] += 1
            return self.inner.compress(window)

    some_of.pair = [Counted(c) for c in some_of.pair]
    windows = 0
    for i in range(40):
        text = [rng.choice(vocab[:380]) for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = [*rng.choice(phrases), rng.choice(vocab[380:])]
        if i % 5 == 0:
            text += text[:9]
        spans = all_of.spans(text)
        windows += 2 * len(spans) + 2 * len(set(text))
        assert some_of.gains(text) == [max(0, d) for d in spans]
        assert [w for w in text if some_of.word_gain(w) >= 4] == [w for w in text if all_of(w) >= 4]
        assert all(some_of.word_gain(w) == all_of(w) for w in text if all_of(w) >= 4)
    assert 0 < called["n"] < windows / 10


def test_toxicity_of_nothing(spark):
    docs, labels, _ = labelled(spark, 20)
    model = X.fit(docs, labels.limit(0))
    assert {r["score"] for r in X.score(docs, model).collect()} == {0.5}
    assert X.score(docs.limit(0), model).count() == 0


def test_ordinal_grades(spark):
    docs, labels, known = labelled(spark)
    how = O.Fit(bits=10, steps=200)
    model = O.fit(docs, O.graded(labels), how)
    assert (np.diff(model.thresholds) > 0).all()
    rows = O.grade(docs, model).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and known.get(r["doc_id"], (None,))[0] is not None]
    assert np.mean([r["kept"] == bool(known[r["doc_id"]][0]) for r in held]) > 0.95
    assert all(r["tail_probability"] <= r["expected_grade"] <= 2 and r["kept"] == (r["tail_probability"] >= 0.5) for r in rows)
    mean = {g: np.mean([r["expected_grade"] for r in rows if r["doc_id"] in known and known[r["doc_id"]] == g]) for g in ((0, 0), (1, 1), (1, 0))}
    assert mean[0, 0] < mean[1, 1] < mean[1, 0]
    empty = O.fit(docs, O.graded(labels.limit(0)), how)
    assert O.grade(docs, empty).count() == docs.count() and O.grade(docs.limit(0), empty).count() == 0


def test_ordinal_gradient():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    z = x @ np.array([2, -1, 0.5, 0, 0]) + rng.logistic(size=300)
    grade = (z > -0.5).astype(int) + (z > 1.5)
    model = O.solve(x, grade, O.Fit(steps=1500, rate=0.05, decay=0.0))
    assert np.allclose(model.weights, [2, -1, 0.5, 0, 0], atol=0.5) and np.allclose(model.thresholds, [-0.5, 1.5], atol=0.5)


PAGE = """<!DOCTYPE html><html><head><title>T %d</title><style>p{x:1}</style><script>var a="</p><p>no";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>hidden</p> --><article><h1>Head %d &amp; more</h1><p>First&nbsp;&nbsp;para %d,
 split <b>bold</b> text<br>next line<p>Unclosed &lt;b&gt; &#233;&hellip;</p><ul><li>one %d<li>two</ul><div class="ad">Buy %d</div>
<table><tr><td>c1<td>c2 %d</table><form><p>Your name</p></form><blockquote><p>quote %d</p></blockquote></article>
<aside>more</aside><section id="comments"><p>reader %d</p></section><footer>foot %d</footer></body></html>"""
WANT = "Head %d & more\n\nFirst para %d, split bold text next line\n\nUnclosed <b> é…\n\none %d\n\ntwo\n\nc1\n\nc2 %d\n\nquote %d"


def test_pages(spark):
    rows = [(i, f"https://host{i % 2}.example/{i}", PAGE.replace("%d", str(i))) for i in range(12)]
    plain = "<body><div id=menu><a>a</a></div><div class=story><p>Text number {0} is here.</p><p>More of it, {0} times.</p></div><div class=copyright>c {0}</div>"
    rows += [(100 + i, f"http://plain.example:80/{i}", plain.format(i)) for i in range(6)]
    rows += [(200, "http://host1.example/x", None), (201, None, "<p>Just a text"), (202, "not a url", "no tags < 5 & more"), (203, "http://host1.example/y", ""),
             (204, "http://deep.example/", "<div>" * 300 + "deep" + "</div>" * 300), (205, "http://long.example/", "<p>" + "word " * 60_000), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("text", F.lit("t"))
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == dict((k, u) for k, u, _ in rows)[r["page_id"]] for r in got)
    for i in range(12):
        assert text[i] == WANT.replace("%d", str(i))
    for i in range(6):
        assert text[100 + i] == f"Text number {i} is here.\n\nMore of it, {i} times."
    assert text[200] == text[203] == "" and text[201] == "Just a text" and text[202] == "no tags < 5 & more"
    assert text[204] == "deep" and len(text[205]) == 60_000 * 5 - 1
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("url", ["http://mixed.example/{0}", None])
def test_layouts_of_one_host(spark, url):
    article = "<body><div>nav of the site</div><article><h1>Head {0}</h1><p>Article text number {0}.</p></article></body>"
    story = "<body><div>nav of the site</div><section><div class=story><p>Story number {0} is here.</p><p>More of it, {0} times.</p></div></section></body>"
    table = "<body><table><tr><td><p>Cell number {0} says much.</p></td></tr></table></body>"
    pair = "<body><div><div><p>One part {0} of two.</p></div><section><p>Other part {0} of two.</p></section></div></body>"
    want = ["Head {0}\n\nArticle text number {0}.", "Story number {0} is here.\n\nMore of it, {0} times.", "Cell number {0} says much.",
            "One part {0} of two.\n\nOther part {0} of two."]
    rows = [(10 * i + n, url and url.format(10 * i + n), h.format(10 * i + n)) for i in range(6) for n, h in enumerate((article, story, table, pair))]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want[i % 10].format(i) for i, _, _ in rows}


NAMED = {
    '<body class="has-sidebar"><article><p>Text {0}.</p></article><div class="sidebar">s</div></body>': "Text {0}.",
    '<body class="search" id="header"><div id="page" class="header-fixed"><article class="post has-comments"><p>Text {0}.</p></article></div></body>': "Text {0}.",
    '<body><div class="page header"><main class="alert"><p>Text {0}.</p></main></div><div class="copyright">c {0}</div></body>': "Text {0}.",
    '<body><div id="search"><div><p>Only text {0}.</p></div></div></body>': "Only text {0}.",
    '<body><article><h2 id="related-work">Related {0}</h2><section id="search-trees"><p id="side">Trees {0}</p></section>'
    '<div id="side-effects"><p class="alert">Effects {0}</p></div><h3 class="notice">End</h3><div class="ad">Buy</div>'
    '<div class="share-buttons">Share</div></article><div id="comments"><article>reader {0}</article></div></body>':
        "Related {0}\n\nTrees {0}\n\nEffects {0}\n\nEnd",
}


def test_names_that_are_no_asides(spark):
    rows = [(10 * i + n, f"http://named{n}.example/", h.format(10 * i + n)) for i in range(4) for n, h in enumerate(NAMED)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: list(NAMED.values())[i % 10].format(i) for i, _, _ in rows}


@pytest.mark.parametrize("deep", [50, 58, 70, 3000])
def test_text_after_deep_nesting(spark, deep):
    inner = "<div>" * deep + "<p>deep {0}</p>own<nav>menu</nav> more" + "</div>" * deep
    page = f"<body><div><article><p>first</p>{inner}<p>rest {{0}}</p></article></div><div>foot</div></body>"
    low = "<div>" * deep + "<div>side</div><article><p>low {0}</p></article><div>foot</div>" + "</div>" * deep
    rows = [(i, "http://deep.example/", page.format(i)) for i in range(3)] + [(9, "http://low.example/", low.format(9))]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"first\n\ndeep {i}\n\nown more\n\nrest {i}" for i in range(3)} | {9: "low 9"}


def test_alignment():
    def w(h):
        return H.wrapper_of(H.page_tree(h))

    def shape(x):
        return [x[0] + x[1], *map(shape, x[2])] if x[0] != "#" else "#var" if x[1] else "#"

    assert shape(w("<ul><li>a<li>b<li>c</ul>")) == ["#root", ["ul", ["li+", "#var"]]]
    both = H._merged(w("<h1>x</h1><p>a</p>"), w("<h1>x</h1><img><h2>s</h2><p>b</p><p>c</p>"))
    assert shape(both) == ["#root", ["h1", "#"], ["h2?", "#"], ["p+", "#var"]]
    a, b, c = (w(f"<div>{x}</div>") for x in ("<p>1</p>", "<h2>t</h2><p>2</p>", "<p>3</p><ul><li>x</ul>"))
    assert shape(H._merged(H._merged(a, b), c)) == shape(H._merged(H._merged(c, b), a))
    assert H._merged(a, a) == [a[0], a[1], [[*a[2][0][:2], [[*a[2][0][2][0][:2], [["#", 0, a[2][0][2][0][2][0][2], 2]]]]]]]


def test_against_plain_patterns(spark):
    """The given pages have one layout, which plain patterns can read."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert got[r["page_id"]] == "\n\n".join(filter(None, blocks))


ODD_PAGES = [
    ("<html><head><title>t</title><meta charset=utf-8><body><article><p>open head {0}</p></article></body>", "open head {0}"),
    ("<head><link rel=x href=y>just text {0}", "just text {0}"),
    ("<article><svg/><object/><p>after drawings {0}</p></article>", "after drawings {0}"),
    ("<article><svg><path d=1><p>unended {0}</p></article>", "unended {0}"),
    ("<article><script src=a.js></script><p data-x=it's>it is {0}</p><p title=\"a > b\">x</p></article>", "it is {0}\n\nx"),
    ("<article><p>story {0}</p><div class=comment-body><p>me too</p></div><ul><li class=comments-list-item>first</li></ul><ins class=adsbygoogle>Buy</ins>"
     "<div class='box ad-slot'>Buy</div><div class=article-share-tools>Share</div><div class=has-comments>kept</div></article>", "story {0}\n\nkept"),
    ("<body><div id=wrap><div class=story><p>short {0}</p></div><ol class=commentlist><li>a reader says {0} this and</li><li>that {0} and more</li></ol></div></body>",
     "short {0}"),
    ("<body class=has-sidebar><div class=content-with-sidebar><section id=market-share><p>share {0} of it</p></section></div></body>", "share {0} of it")]


def test_odd_pages_in_any_partitioning(spark):
    rows = [(100 * i + n, f"http://odd{n}.example/{i}", page.format(i)) for i in range(7) for n, (page, _) in enumerate(ODD_PAGES)]
    want = {100 * i + n: text.format(i) for i in range(7) for n, (_, text) in enumerate(ODD_PAGES)}
    for parts in (1, 7, 50):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r["page_id"]: r["text"] for r in H.extract(df).collect()} == want, parts
