import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # names the operators use inside, as columns of the input
                     T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("lines", T.StringType()),
                     T.StructField("hash", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text, source) rows."""
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", "f", "l", "h") for i, t, s in rows], DOCS)

    return make


@pytest.fixture
def corpus():
    """Some 60 documents: plain, copied, edited, with shared lines, empty, null, long, repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def line(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    shared = [line(9) for _ in range(3)]
    rows = []
    for i in range(39):
        parts = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(0, shared[i % 2])
        rows.append((i, "\n".join(parts), f"s{i % 3}"))
    rows += [(100 + i, rows[i % 4][1], "s0") for i in range(12)]  # copies
    rows += [(200 + i, rows[5][1].replace(" ", "  ", 1).upper(), "s1") for i in range(2)]
    edited = [line(150) for _ in range(3)]
    for i in range(5):
        rows.append((39 + 260 * (i > 0) + i, "\n".join(edited), "s2"))
        edited[i % 3] = edited[i % 3].replace(" ", f" {vocab[i]} ", 1)
    rows += [(400, None, "s0"), (401, "", "s0"), (402, " \n\t ", None), (403, "one", None), (None, rows[0][1], "s1"), (None, None, None),
             (404, "\n".join(line(12) for _ in range(900)), "s2"), (405, "é ö ẞ x\n" * 40, "s2"), rows[3], rows[3]]
    return rows
