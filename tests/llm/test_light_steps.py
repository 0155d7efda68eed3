"""What op6 passes on: filters, anchors as arrays, hash joins."""

import numpy as np

from revsync.llm import bloom, suffix_array

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _copies(docs_of, spark, n=40):
    text = " ".join(f"word{k}" for k in range(300))
    return docs_of(spark, [(i, f"{text[i % 20 * 7 :]} end {i}", "en", "a") for i in range(n)])


def test_a_filter_lets_all_its_names_through(spark):
    rows = spark.range(0, 5000, 1, 3).selectExpr("xxhash64(id) as name")
    names = np.array([r.name for r in rows.collect()]).view(np.uint64)
    read = lambda batches: (np.asarray(b.column(0)).view(np.uint64) for b in batches)
    bits = bloom.build(rows, read).value
    assert bloom.among(bits, names).all()
    assert bloom.among(bits, names + np.uint64(1)).sum() < 50
    assert not bloom.build(rows.where("name is null"), read).value.any()


def test_packed_anchors_keep_the_ends_of_each():
    r = np.random.default_rng(1)
    q = r.integers(0, 40, 500).astype(np.uint64) << np.uint64(58)
    doc = r.integers(0, 9, 500)
    batch = suffix_array._packed(q, doc)
    got = {}
    for part, qs, docs in zip(*(c.to_pylist() for c in batch.columns)):
        for x, y in zip(np.frombuffer(qs, np.uint64).tolist(), np.frombuffer(docs, np.int64).tolist()):
            assert x >> (64 - suffix_array.RANGES) == part
            got.setdefault(x, set()).add(y)
    want = {int(x): {int(doc[q == x].min()), int(doc[q == x].max())} for x in np.unique(q)}
    assert got == want and len(set(batch.column(0).to_pylist())) == batch.num_rows
    assert suffix_array._packed(q[:0], doc[:0]).num_rows == 0


def test_op6_joins_by_hash_tables(spark, docs_of, monkeypatch):
    key, seen, stage = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", {}, suffix_array.stage

    def watched(df, name):
        seen[name] = spark.conf.get(key)
        return stage(df, name)

    monkeypatch.setattr(suffix_array, "stage", watched)
    before = spark.conf.get(key)
    assert suffix_array.dedup(_copies(docs_of, spark)).count() == 40
    assert seen["suffix-contexts"] == seen["suffix-second"] == spark.conf.get(ADVISORY)
    assert spark.conf.get(key) == before
