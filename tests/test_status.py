import pytest
from helpers import rows

from revsync import vocab
from revsync.operators import status, upsert
from revsync.sources import dims

MAPPING = "provider string, raw_status string, canonical_status string"


def mapped(spark, mapping, *words):
    df = spark.createDataFrame(list(words), "provider string, raw_status string")
    m = spark.createDataFrame(mapping, MAPPING)
    return rows(status.map_status(df, m))


def test_known_unknown_and_scope(spark):
    mapping = [("stripe", "succeeded", "collected"), ("hubspot", "paid", "collected")]
    got = mapped(
        spark, mapping,
        ("stripe", "succeeded"), ("stripe", "paid"), ("hubspot", "paid"), ("hubspot", None),
    )
    assert set(got) == {
        ("stripe", "succeeded", "collected"),
        ("stripe", "paid", "unknown"),
        ("hubspot", "paid", "collected"),
        ("hubspot", None, "unknown"),
    }


def test_empty_mapping(spark):
    assert mapped(spark, [], ("stripe", "succeeded")) == [("stripe", "succeeded", "unknown")]


def test_case_and_every_white_space_fold(spark):
    mapping = [("stripe", " SUCCEEDED ", "collected")]
    for word in ("succeeded", "Succeeded", "\t succeeded\n", "　succeeded﻿"):
        assert mapped(spark, mapping, ("stripe", word))[0][2] == "collected", repr(word)
    assert mapped(spark, mapping, ("stripe", "succ eeded"))[0][2] == "unknown"


def test_two_rows_folding_to_one_word_give_one(spark):
    mapping = [("stripe", "Paid", "pending"), ("stripe", "paid", "collected")]
    assert mapped(spark, mapping, ("stripe", "PAID")) == [("stripe", "PAID", "collected")]


def test_remap_applies_an_edit(spark):
    stored = spark.createDataFrame(
        [("stripe", "x", "unknown", 1)],
        "provider string, raw_status string, canonical_status string, n int",
    )
    m = spark.createDataFrame([("stripe", "x", "collected")], MAPPING)
    assert rows(status.remap(stored, m)) == [("stripe", "x", "collected", 1)]


def test_mapping_upsert(spark):
    seed = dims.status_mapping_seed(spark)
    edits = spark.createDataFrame(
        [("stripe", "succeeded", "pending"), ("stripe", "new", "failed")], MAPPING
    )
    got = dict((r.raw_status, r.canonical_status) for r in upsert.upsert_mapping(seed, edits).collect())
    assert got["succeeded"] == "pending" and got["new"] == "failed"
    assert len(got) == len(vocab.STATUS_MAPPING_SEED) + 1


@pytest.mark.parametrize("row", [("paypal", "x", "collected"), ("stripe", "x", "settled")])
def test_bad_mapping_rows_fail_the_job(spark, row):
    bad = spark.createDataFrame([row], MAPPING)
    with pytest.raises(Exception, match="bad payment status mapping"):
        dims.check_status_map(bad).collect()
