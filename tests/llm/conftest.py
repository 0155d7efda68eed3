import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use for columns of their own.
CLASHING = ["row", "id", "key", "cls", "n", "w", "words", "size", "target", "score", "c0", "t", "u",
            "value", "found", "part", "version", "host", "rank", "gram", "component"]


def make_docs(spark, rows, clash=False):
    """Documents of (doc_id, text, lang, source); with `clash`, extra columns of such names."""
    df = spark.createDataFrame([(i, t, la, s, len(t) if t else None) for i, t, la, s in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit("x"))
    return df


def corpus(seed=1, n=60, words=40):
    """Rows with near copies, exact copies, nulls, empty and very long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, words))) for _ in range(n)]
    for i in range(12):  # near copies
        w = texts[i % 4].split() * 2
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:5] + [texts[0]] * 6
    texts += [None, None, "", "", " \t\n", "Ünïcode Ça, va. ÉTÉ İ K", "." * 30, "a b", "A  B"]
    texts.append(" ".join(r.choices(vocabulary, k=30_000)))
    texts.append("x" * 200_000)
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "Z", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[1], None, None), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs_of():
    return make_docs


@pytest.fixture(scope="session")
def rows_of_corpus():
    return corpus()
