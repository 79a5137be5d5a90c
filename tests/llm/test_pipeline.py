"""The stages one after the other, and the registered queries on the smallest data."""
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stayledger.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_columns_and_decisions(stages):
    columns = stages[0][1].columns
    rows = {}
    for name, df in stages:
        assert df.columns[:len(columns)] == columns
        rows[name] = df.collect()
        if name != "documents":
            assert all(r["n_chars"] == len(r["text"]) for r in rows[name])
    before = {r["doc_id"]: r for r in rows["documents"]}
    assert all(len(WORD.findall(r["text"])) > 0 for r in rows["line_dedup"])
    for a, b in (("documents", "quality_rules"), ("quality_rules", "line_dedup"), ("line_dedup", "near_dedup")):
        one, two = {r["doc_id"]: r["text"] for r in rows[a]}, {r["doc_id"]: r["text"] for r in rows[b]}
        assert set(two) <= set(one) and len(rows[b]) == len(two)
        for i, t in two.items():  # a text only ever loses whole lines
            assert not Counter(t.split("\n")) - Counter(one[i].split("\n"))
    assert len(rows["near_dedup"]) == len({r["text"] for r in rows["near_dedup"]})
    taken = sum(len(WORD.findall(r["text"])) for r in rows["source_mixing"])
    whole = sum(len(WORD.findall(r["text"])) for r in rows["near_dedup"])
    sources = {r["source"] for r in rows["near_dedup"]}
    assert 1.5 * whole - len(sources) <= taken <= 1.5 * whole
    assert len(rows["tokens"]) == len(rows["source_mixing"]) and all(r["n_tokens"] > 0 for r in rows["tokens"])
    assert {r["doc_id"] for r in rows["tokens"]} <= set(before)


def test_registered(spark):
    names = entry.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and len(queries.QUERIES) == 13 and "pipeline" in names
    assert all(re.match(rf"op{i}_", n) for i, n in enumerate(queries.QUERIES, 1))


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for base in ("stayledger", "workload"):
        for d, _, names in os.walk(os.path.join(root, base)):
            if "llm" not in d.split(os.sep):
                for n in names:
                    if n.endswith(".py"):
                        assert "llm" not in open(os.path.join(d, n)).read()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, make_docs, corpus, name):
    """Nulls, empty and long texts, copies, repeated rows, columns of the operators' own names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = make_docs([*corpus, (410, None, None), (411, "x", None)]).withColumn("n_tokens", corpus_pipeline.F.lit("t"))
    out = stage(spark, docs, SF)
    own = [c for c in docs.columns if not (name == "tokens" and c == "n_tokens")]
    assert [c for c in out.columns if c in own] == own
    rows = out.collect()
    texts = {(i, t) for i, t, _ in corpus} | {(411, "x"), (410, None)}
    if name == "tokens":
        assert len(rows) == len(corpus) + 2 and all(isinstance(r["n_tokens"], int) for r in rows)
    elif name == "near_dedup":
        assert len(rows) == len({r["text"] for r in rows}) and all((r["doc_id"], r["text"]) in texts for r in rows)
    elif name == "source_mixing":
        assert all(r["text"] and (r["key"], r["fp"]) == ("k", "f") for r in rows)
    elif name == "quality_rules":
        assert all(len(WORD.findall(r["text"])) > 0 for r in rows) and {404, 405} & {r["doc_id"] for r in rows}
    else:
        assert {400, 401, 402} <= {r["doc_id"] for r in rows}  # never held a line, so none was taken
    assert stage(spark, docs.limit(0), SF).count() == 0
