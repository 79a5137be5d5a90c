"""Labels of documents, and versions that appear whole or not at all."""
import pytest
from build import SETTINGS, words

from stayledger.plans import incremental as I
from stayledger.plans.publish import children, publish, published

STATE, KNOWN = "doc string, state bigint", "doc string, state bigint, label bigint"


def labelled(spark, docs, known):
    rows = I.label_documents(spark.createDataFrame([(d, 1) for d in docs], STATE), spark.createDataFrame(known, KNOWN)).collect()
    got = {r.doc: r.label for r in rows}
    assert len(got) == len(rows) == len(docs)
    assert [d for d, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(docs)  # in the order of paths
    return got


def test_labels_are_kept_and_follow_the_paths(spark):
    first = labelled(spark, [f"m{i:03}" for i in range(40)], [])
    known = [(d, 1, n) for d, n in first.items()]
    docs = [d for d in first if d not in ("m007", "m039")] + ["a", "m003b", "m003c", "m038x", "z1", "z2"]
    second = labelled(spark, docs, known)
    assert all(second[d] == first[d] for d in docs if d in first)
    assert labelled(spark, docs, [(d, 1, n) for d, n in second.items()]) == second
    assert labelled(spark, [], known) == {}


def test_a_full_gap_is_refused(spark):
    with pytest.raises(Exception, match="no label is left"):
        labelled(spark, ["a", "b", "c"], [("a", 1, 5), ("c", 1, 6)])


def test_publishing(spark, tmp_path):
    base = str(tmp_path / "base")
    assert published(spark, base, "v-") is None

    def broken(folder):
        spark.range(3).write.parquet(f"{folder}/t")
        raise ValueError("no")

    publish(spark, base, "v-1", lambda f: spark.range(2).write.parquet(f"{f}/t"))
    with pytest.raises(ValueError):
        publish(spark, base, "v-2", broken)
    assert published(spark, base, "v-") == f"{base}/v-1" and spark.read.parquet(f"{base}/v-1/t").count() == 2
    with pytest.raises(RuntimeError):
        publish(spark, base, "v-1", lambda f: spark.range(9).write.parquet(f"{f}/t"))
    assert spark.read.parquet(f"{base}/v-1/t").count() == 2 and "v-1" in children(spark, base)


def test_state_covers_all_files_of_a_document(spark):
    rows = words(spark, [("a", 1, 5, [(1, "x")]), ("a", 2, 5, [(1, "y")]), ("b", 1, 5, [(1, "z")])])
    one = rows.selectExpr("*", "concat('f', page) AS file_path", "TIMESTAMP'2026-01-01' AS changed_at")
    two = rows.selectExpr("*", "concat('f', page) AS file_path", "if(page = 2, TIMESTAMP'2026-01-02', TIMESTAMP'2026-01-01') AS changed_at")
    before, after = ({r.doc: r.state for r in I.document_states(x).collect()} for x in (one, two))
    assert before["b"] == after["b"] and before["a"] != after["a"] and SETTINGS
