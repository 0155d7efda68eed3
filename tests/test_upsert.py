"""Upserts, in memory and committed to disk."""

import random

import pytest
from helpers import at, rows

from revsync import schemas, session
from revsync.operators import upsert
from revsync.plans.store import Cursor, Log, Table

ROW = schemas.struct(
    provider="string", source_id="string", amount_minor="bigint", source_updated_at="timestamp_ntz"
)
BATCH = "provider string, source_id string, amount_minor bigint, source_updated_at timestamp_ntz, arrival_seq int"
T1, T2, T3 = at("2026-01-01"), at("2026-01-02"), at("2026-01-03")
NOW = at("2026-02-01")


def frame(spark, *data):
    return spark.createDataFrame([("stripe", *d) for d in data], ROW)


def table(spark, root, **kw):
    return Table(spark, root, ROW, **kw)


def test_same_record_twice(spark, root):
    t = table(spark, root)
    batch = frame(spark, ("a", 1, T1))
    first, second = t.commit(batch, NOW), t.commit(batch, NOW)
    assert (first.created, first.updated, first.unchanged) == (1, 0, 0)
    assert (second.created, second.updated, second.unchanged) == (0, 0, 1)
    assert rows(t.read()) == [("stripe", "a", 1, T1)]


def test_later_change_updates_one_row(spark, root):
    t = table(spark, root)
    t.commit(frame(spark, ("a", 1, T1), ("b", 2, T1)), NOW)
    assert t.commit(frame(spark, ("a", 9, T2)), NOW).updated == 1
    assert rows(t.read()) == [("stripe", "a", 9, T2), ("stripe", "b", 2, T1)]


def test_unchanged_time_is_still_written_and_older_wins_by_arrival(spark, root):
    t = table(spark, root)
    t.commit(frame(spark, ("a", 1, T2), ("b", 1, T2)), NOW)
    done = t.commit(frame(spark, ("a", 5, T2), ("b", 6, T1)), NOW)
    assert (done.unchanged, done.updated) == (1, 1)
    assert rows(t.read()) == [("stripe", "a", 5, T2), ("stripe", "b", 6, T1)]


def test_newest_policy_keeps_the_newer_row(spark, root):
    t = table(spark, root)
    t.commit(frame(spark, ("a", 1, T2), ("b", 1, T2), ("c", 1, None)), NOW)
    t.commit(frame(spark, ("a", 5, T1), ("b", 6, T3), ("c", 7, T1)), NOW, policy="newest")
    assert rows(t.read(), "source_id", "amount_minor") == [("a", 1), ("b", 6), ("c", 7)]


def test_records_and_cursor_appear_together(spark, root):
    t = table(spark, root)
    assert t.cursor("stripe", "payment") is None
    t.commit(frame(spark, ("a", 1, T1)), NOW, cursor=Cursor("stripe", "payment", "100", NOW))
    assert t.cursor("stripe", "payment") == Cursor("stripe", "payment", "100", NOW)
    assert t.read().count() == 1
    t.commit(frame(spark, ("b", 1, T1)), NOW)  # a webhook's batch brings no cursor
    assert t.cursor("stripe", "payment").token == "100"
    t.clear_cursor("stripe", "payment", NOW)
    assert t.cursor("stripe", "payment") is None and t.read().count() == 2


def test_blank_cursors_are_refused(spark):
    with pytest.raises(ValueError):
        Cursor("stripe", "payment", "  ", NOW)
    issued = spark.createDataFrame(
        [("stripe", "payment", " ", T1, None)],
        "provider string, entity_type string, token string, issued_at timestamp_ntz, "
        "expires_at timestamp_ntz",
    )
    with pytest.raises(Exception, match="must not be blank"):
        upsert.cursor_upsert(issued.limit(0), issued).collect()


def test_job_that_dies_before_its_commit_row_leaves_nothing(spark, root):
    t = table(spark, root)
    t.commit(frame(spark, ("a", 1, T1)), NOW)
    # The data of version 2 is written, and then the driver is lost.
    upsert.upsert_outcomes(frame(spark, ("a", 7, T2)), t.read()).write.parquet(
        f"{root}/deltas/data={t._name(2)}"
    )
    assert rows(t.read()) == [("stripe", "a", 1, T1)]
    t.commit(frame(spark, ("b", 2, T1)), NOW)
    assert rows(t.read(), "source_id", "amount_minor") == [("a", 1), ("b", 2)]


def test_two_writers_at_one_version_both_stand(spark, root, monkeypatch):
    """The second finds its version taken when all but its commit row is written."""
    first, second = table(spark, root), table(spark, root)
    first.commit(frame(spark, ("a", 1, T1)), NOW)
    commit, tried = second._commit, []

    def late(version, values):
        if not tried:
            first.commit(frame(spark, ("a", 2, T2), ("b", 2, T1)), NOW, batch_id="first")
        tried.append(version)
        commit(version, values)

    monkeypatch.setattr(second, "_commit", late)
    done = second.commit(frame(spark, ("b", 3, T2), ("c", 3, T1)), NOW, batch_id="second")
    assert tried == [2, 3] and (done.version, done.created, done.updated) == (3, 1, 1)
    assert rows(first.read(), "source_id", "amount_minor") == [("a", 2), ("b", 3), ("c", 3)]
    assert rows(first.changes(2), "source_id") == [("a",), ("b",)]
    assert first.commit(frame(spark, ("z", 0, T1)), NOW, batch_id="second").repeated


def test_fold_leaves_out_what_came_meanwhile(spark, root, monkeypatch):
    t, other = table(spark, root), table(spark, root)
    t.commit(frame(spark, ("a", 1, T1)), NOW)
    commit, tried = t._commit, []

    def late(version, values):
        if not tried:
            other.commit(frame(spark, ("a", 2, T2), ("b", 2, T1)), NOW)
        tried.append(version)
        commit(version, values)

    monkeypatch.setattr(t, "_commit", late)
    t.fold(NOW)
    assert rows(t.read(), "source_id", "amount_minor") == [("a", 2), ("b", 2)]


def test_repeated_keys_without_an_order_are_refused(spark, root):
    t = table(spark, root)
    with pytest.raises(ValueError, match="each key once"):
        t.commit(frame(spark, ("a", 1, T1), ("a", 2, T2)), NOW)
    assert t.read().count() == 0 and t.commits().count() == 0


def test_log_batches_are_written_once(spark, root):
    log = Log(spark, f"{root}/log", ROW)
    log.append(frame(spark, ("a", 1, T1)), "x:1")
    log.append(frame(spark, ("a", 1, T1)), "x:1")
    log.append(frame(spark, ("b", 1, T1)), "x/1")
    log.append(frame(spark, ("c", 1, T1)))
    assert sorted(r.source_id for r in log.read().collect()) == ["a", "b", "c"]


def test_repeated_batch_changes_nothing(spark, root):
    t = table(spark, root)
    first = t.commit(frame(spark, ("a", 1, T1)), NOW, batch_id="q:0")
    again = t.commit(frame(spark, ("a", 1, T1)), NOW, batch_id="q:0")
    assert again.repeated and again.version == first.version and again.created == 1
    assert t.commits().count() == 1


def test_empty_batch_commits_its_cursor(spark, root):
    t = table(spark, root)
    done = t.commit(frame(spark).limit(0), NOW, cursor=Cursor("stripe", "payment", "5", NOW))
    assert done.upserted == 0 and t.read().count() == 0
    assert t.cursor("stripe", "payment").token == "5"


def test_compaction_keeps_rows_and_prunes_months(spark, root):
    t = table(spark, root, month_of="source_updated_at")
    t.commit(frame(spark, *[(f"k{m}", m, at(f"2026-{m:02d}-15")) for m in range(1, 13)]), NOW)
    t.commit(frame(spark, ("k3", 33, at("2026-03-20"))), NOW)
    before = rows(t.read())
    t.compact(NOW)
    assert rows(t.read()) == before
    plan = t.read(at("2026-03-01"), at("2026-04-01"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2026-03" in plan
    got = rows(t.read(at("2026-03-01"), at("2026-04-01")), "source_id", "amount_minor")
    assert got == [("k3", 33), ("k4", 4)]
    # A change after the compaction moves a row to another month: only there it is found.
    t.commit(frame(spark, ("k3", 34, at("2026-08-01"))), NOW)
    ids = [r.source_id for r in t.read(at("2026-03-01"), at("2026-03-31")).collect()]
    assert sorted(ids) == ["k3"] and t.read().where("source_id = 'k3'").count() == 1
    assert t.read().where("source_id = 'k3'").first().amount_minor == 34


def test_deltas_are_folded_when_they_pile_up(spark, root):
    t = table(spark, root, fold_after=2)
    t.commit(frame(spark, ("a", 0, T1), ("z", 0, T1)), NOW)
    t.compact(NOW)
    for n in range(1, 6):
        t.commit(frame(spark, ("a", n, T1), (f"k{n}", n, T1)), NOW)
    assert [r.kind for r in t.commits().orderBy("version").collect()].count("fold") == 2
    assert len(t._versions()[2]) <= 2
    want = [("a", 5), *[(f"k{n}", n) for n in range(1, 6)], ("z", 0)]
    assert rows(t.read(), "source_id", "amount_minor") == want
    # Earlier versions can still be read as they were.
    assert rows(t.read(version=3), "source_id", "amount_minor") == [("a", 1), ("k1", 1), ("z", 0)]
    assert t.commit(frame(spark, ("a", 9, T1)), NOW).unchanged == 1


def test_batch_order_and_hot_key(spark):
    """A third of a batch is one key: the last to arrive is written, whole and once."""
    data = spark.range(9000).selectExpr(
        "'stripe' provider", "if(id % 3 = 0, 'hot', concat('k', id % 700)) source_id",
        "id amount_minor", "timestamp_ntz'2026-01-01 00:00:00' source_updated_at",
        "cast(id as int) arrival_seq",
    )
    df = upsert.batch_last_write(data)
    want = {}
    for i in range(9000):
        want["hot" if i % 3 == 0 else f"k{i % 700}"] = i
    assert dict(rows(df, "source_id", "amount_minor")) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "copies are cut before the shuffle"


def test_against_row_by_row_upserts(spark, root):
    """Random batches against the plain loop."""
    rng, model, t = random.Random(7), {}, table(spark, root)
    for n in range(4):
        data = [
            (f"k{rng.randrange(30)}", rng.randrange(1000), rng.choice([T1, T2, T3, None]), i)
            for i in range(40)
        ]
        counts = {"created": 0, "updated": 0, "unchanged": 0}
        winners = {k: (a, u) for k, a, u, _ in data}
        for k, (a, u) in winners.items():
            if k not in model:
                counts["created"] += 1
            elif u is not None and model[k][1] == u:
                counts["unchanged"] += 1
            else:
                counts["updated"] += 1
            model[k] = (a, u)
        batch = spark.createDataFrame([("stripe", *d) for d in data], BATCH)
        done = t.commit(batch, NOW, order=["arrival_seq"])
        assert {k: getattr(done, k) for k in counts} == counts
        if n == 1:
            t.compact(NOW)
    got = {r.source_id: (r.amount_minor, r.source_updated_at) for r in t.read().collect()}
    assert got == model


def test_small_batch_does_not_shuffle_the_table(spark, root):
    """The batch, whose size its files tell, is sent to the table's tasks."""
    target = session.stage(frame(spark, *[(f"k{i}", i, T1) for i in range(200)]), "target")
    batch = session.stage(frame(spark, ("k1", 0, T2), ("k1", 1, T2)), "batch")
    batch = upsert.last_per_key(batch, upsert.KEY, ["amount_minor"])
    for df in (upsert.upsert_snapshot(target, batch), upsert.upsert_outcomes(batch, target)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_large_batch_is_not_broadcast(spark):
    """Beyond the threshold the same operator joins by shuffle, and gives the same rows."""
    target = session.stage(frame(spark, *[(f"k{i}", i, T1) for i in range(200)]), "target")
    batch = session.stage(frame(spark, *[(f"k{i}", -i, T2) for i in range(100, 300)]), "batch")
    small = rows(upsert.upsert_snapshot(target, batch))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = upsert.upsert_snapshot(target, batch)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows(df) == small and len(small) == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_audit_rows(spark):
    target = frame(spark, ("a", 1, T1), ("b", 1, T1))
    out = upsert.upsert_outcomes(frame(spark, ("a", 1, T1), ("b", 2, T2), ("c", 3, T1)), target)
    got = rows(upsert.audit_rows(out, "payment", "j", NOW), "source_id", "operation")
    assert got == [("b", "updated"), ("c", "created")]


def test_a_batch_reads_only_its_keys_folders(spark, root):
    """Of deltas, folds and bases alike, for an upsert and for a lookup."""
    t = table(spark, root, buckets=8)
    many = [(f"k{i}", i, T1) for i in range(200)]
    t.commit(frame(spark, *many), NOW)
    t.commit(frame(spark, *many[:50]), NOW)
    one = frame(spark, ("k7", 70, T2))
    asked, read = [], t.read
    t.read = lambda *a, **k: asked.append(k.get("buckets")) or read(*a, **k)
    bucket = t.buckets_of(one)
    assert len(bucket) == 1
    for step in (lambda: t.fold(NOW), lambda: t.compact(NOW), lambda: None):
        t.commit(one, NOW)
        assert asked[-1] == bucket
        found = t.lookup(one)
        assert rows(found) == [("stripe", "k7", 70, T2)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        parts = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
        assert parts and all("key_bucket" in p for p in parts)
        step()
    assert t.read().count() == 200


def test_files_of_other_folders_are_not_opened(spark, root):
    t = table(spark, root, buckets=8)
    t.commit(frame(spark, *[(f"k{i}", i, T1) for i in range(200)]), NOW)
    one = t.buckets_of(frame(spark, ("k7", 70, T2)))
    part = t.read(buckets=one)
    kept = part.count()
    assert 0 < kept < 60
    part = part.select("*")
    part.collect()
    files = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    everything = t.read()
    everything.collect()
    total = everything._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert files < total / 4
