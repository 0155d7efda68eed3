"""What queries leave on executors' disks, and what their tasks hold."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from revsync import session
from revsync.llm import suffix_array
from revsync.llm.common import scoped


def _shuffles(spark):
    """Shuffle files on this machine's executors."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def _gone(spark, before):
    for _ in range(100):
        if not _shuffles(spark) - before:
            return True
        time.sleep(0.1)
    return False


def _copies(docs_of, spark):
    text = " ".join(f"word{k}" for k in range(300))
    return docs_of(spark, [(i, f"{text[i * 7 :]} end {i}", "en", "a") for i in range(40)])


def test_a_staged_query_leaves_no_shuffle_files(spark):
    before = _shuffles(spark)
    rows = session.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "footprint")
    with scoped(spark):
        assert len(spark.range(1000).groupBy(F.col("id") % 5).count().collect()) == 5
    assert _gone(spark, before)
    assert rows.count() == 7


def test_op6_leaves_only_its_covers_staged(spark, docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr("revsync.llm.common.shared_dir", lambda spark: str(tmp_path))
    before = _shuffles(spark)
    docs = _copies(docs_of, spark)
    out = suffix_array.dedup(docs)
    left = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "revsync").iterdir() if p.name != "_scratch")
    assert left == ["suffix-covers", "suffix-several"]
    assert not list((tmp_path / "revsync" / "_scratch").iterdir())
    assert _gone(spark, before)
    seen, want = set(), {}
    for i, data in sorted((r.doc_id, r.text.encode()) for r in docs.collect()):
        strings = {data[k : k + 50]: k for k in range(len(data) - 49)}
        gone = {k + j for x, k in strings.items() if x in seen for j in range(50)}
        seen |= set(strings)
        want[i] = bytes(x for k, x in enumerate(data) if k not in gone)
    assert {r.doc_id: bytes(r.kept) for r in out.collect()} == want


def test_batches_of_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    with scoped(spark):
        texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
        assert texts.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] < 4 << 20
