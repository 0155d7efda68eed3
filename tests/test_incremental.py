"""Loads: mode, watermark, rejects, counters, logs."""

import json
from datetime import timedelta

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from revsync import schemas, vocab
from revsync.operators import upsert
from revsync.plans.incremental import run_incremental
from revsync.plans.warehouse import Warehouse
from revsync.sources import landing, registry
from revsync.streaming.incremental import stream_incremental

NOW = at("2026-02-01T12:00")


def write(spark, path, *objects):
    lines = [(json.dumps(o),) for o in objects]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def intent(id, created, **kw):
    return {"id": id, "created": created, "status": "succeeded", "amount": 100, "currency": "usd",
            **kw}


@pytest.fixture
def w(spark, root):
    return Warehouse(spark, f"{root}/tables")


@pytest.fixture
def landed(spark, root):
    path = f"{root}/landing"

    def land(*objects):
        write(spark, path, *objects)
        return landing.read_landed(spark, path, schemas.PAYMENT_INTENT)

    return land


def run(w, df, job, now=NOW, **kw):
    return run_incremental(w, registry.PAYMENTS, df, now, job, **kw)


def test_full_then_incremental_then_stale(w, landed):
    first = run(w, landed(intent("a", 100), intent("b", 200)), "j1")
    assert (first.mode, first.outcome, first.records_fetched) == ("full", "success", 2)
    assert w.tables["payment"].cursor("stripe", "payment").token == "200"
    # The watermark itself is read again, which changes nothing.
    second = run(w, landed(intent("c", 300)), "j2", NOW + timedelta(hours=1))
    assert (second.mode, second.records_fetched, second.records_upserted) == ("incremental", 2, 1)
    assert w.tables["payment"].cursor("stripe", "payment").token == "300"
    late = run(w, landed(), "j3", NOW + timedelta(hours=26))
    assert (late.mode, late.records_fetched, late.fell_back) == ("full", 3, False)
    assert [r.source_id for r in w.tables["payment"].read().orderBy("source_id").collect()] == [
        "a", "b", "c",
    ]


def test_watermark_before_what_is_landed_falls_back_to_full(w, landed):
    run(w, landed(intent("a", 100)), "j1")
    result = run(
        w, landed(intent("b", 50)), "j2", NOW + timedelta(hours=1),
        retained_from=at("1970-01-01T00:02"),
    )
    assert (result.mode, result.fell_back, result.records_fetched) == ("full", True, 2)
    assert w.tables["payment"].cursor("stripe", "payment").token == "100"


def test_outcomes_and_logs(w, landed):
    df = landed(intent("a", 100), intent("b", 100, amount=-1), intent("c", 100, currency="x"))
    result = run(w, df, "j1")
    assert (result.outcome, result.records_upserted, result.records_failed) == (
        "partial_failure", 1, 2,
    )
    log = w.failures.read().where("job_id = 'j1'")
    assert sorted(json.loads(json.loads(r.context)["raw"])["id"] for r in log.collect()) == ["b", "c"]
    again = run(w, landed(), "j2", NOW + timedelta(hours=1))
    assert (again.outcome, again.records_upserted, again.records_failed) == ("failed", 0, 2)
    jobs = rows(w.jobs.read(), "id", "mode", "outcome", "records_fetched")
    assert jobs == [("j1", "full", "partial_failure", 3), ("j2", "incremental", "failed", 3)]
    assert rows(w.audit.read(), "source_id", "operation", "job_id") == [("a", "created", "j1")]
    payment = w.tables["payment"].read().first()
    assert payment.synced_at == NOW + timedelta(hours=1) and payment.canonical_status == "collected"


def test_empty_loads_keep_or_start_the_watermark(w, landed):
    nothing = landed(intent("a", 5)).limit(0)
    assert run(w, nothing, "j0").outcome == "success"
    assert w.tables["payment"].cursor("stripe", "payment").token == "0"
    run(w, landed(), "j1", NOW + timedelta(hours=1))
    later = NOW + timedelta(hours=2)
    run(w, landed().limit(0), "j2", later)
    cursor = w.tables["payment"].cursor("stripe", "payment")
    assert (cursor.token, cursor.issued_at) == ("5", later)


def test_a_failing_load_is_reported_and_contained(w, spark):
    broken = spark.createDataFrame([(1,)], "nothing int")
    result = run(w, broken, "j1")
    assert result.outcome == "failed" and result.error
    assert [r.error_code for r in w.failures.read().collect()] == ["UNEXPECTED_ERROR"]
    assert rows(w.jobs.read(), "id", "outcome", "records_fetched") == [("j1", "failed", 0)]


def test_failure_log_that_cannot_be_written_does_not_fail_the_load(w, landed):
    w.failures.append = lambda rows_: (_ for _ in ()).throw(RuntimeError("full disk"))
    assert run(w, landed(intent("a", 1), intent("b", 1, amount=-1)), "j1").outcome == "partial_failure"


def test_running_maximum_survives_an_older_page(spark):
    pages = spark.createDataFrame(
        [("d", "2026-01-05T00:00:00Z"), ("d", "2026-01-01T00:00:00Z")], "source string, modified string"
    )
    from pyspark.sql import functions as F

    from revsync.functions import times

    got = upsert.max_watermark(pages, times.iso_ts(F.col("modified")), ["source"])
    assert rows(got) == [("d", at("2026-01-05"))]
    prior = spark.sql("select 'd' source, timestamp_ntz'2026-03-01' watermark")
    assert rows(upsert.max_watermark(pages, times.iso_ts(F.col("modified")), ["source"], prior)) == [
        ("d", at("2026-03-01"))
    ]


def test_stream_reads_what_is_new_and_repeats_nothing(w, spark, root):
    path, checkpoint = f"{root}/landing", f"{root}/checkpoint"

    def go():
        stream = landing.stream_landed(spark, path, schemas.PAYMENT_INTENT)
        stream_incremental(w, registry.PAYMENTS, stream, checkpoint).awaitTermination()
        return rows(w.tables["payment"].read(), "source_id", "amount_minor")

    write(spark, path, intent("a", 1), intent("b", 1, amount=-1))
    assert go() == [("a", 100)]
    write(spark, path, intent("a", 1, amount=7), intent("c", 2))
    assert go() == [("a", 7), ("c", 100)]
    versions = w.tables["payment"].commits().count()
    assert go() == [("a", 7), ("c", 100)]
    assert w.tables["payment"].commits().count() == versions
    assert w.failures.read().count() == 1


def test_views(w, landed, spark):
    run(w, landed(intent("a", 1)), "j1")
    w.register_views()
    got = spark.sql("select canonical_status, sum(amount_minor) from canonical_payments group by 1")
    assert rows(got) == [("collected", 100)]
    assert spark.sql("select outcome from job_history").first()[0] == vocab.SUCCESS


def test_revenue_reads_its_months_and_columns_only(spark, w, landed):
    from revsync.operators import revenue

    day = 86400
    run(w, landed(*[intent(f"p{i}", 1767225600 + i * day) for i in range(120)]), "j1")
    w.tables["payment"].compact(NOW)
    start, end = at("2026-02-10"), at("2026-03-10")
    df = revenue.revenue(w.tables["payment"].read(start, end), start, end, "month")
    assert rows(df, "bucket_start", "amount_minor", "payment_count") == [
        (at("2026-02-01"), 1900, 19), (at("2026-03-01"), 900, 9),
    ]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = revenue.revenue(w.tables["payment"].read(start, end), start, end, "month")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(occurred_at,2026-02-10" in plan
    assert "EqualTo(canonical_status,collected)" in plan
    assert "(month#" in plan.split("PartitionFilters:")[-1]
    assert "raw" not in plan.split("ReadSchema:")[-1]


def test_payments_bound_reaches_the_scan(spark, root):
    """An incremental load of stored payloads skips what is older than its watermark."""
    payload = "id string, created bigint, status string"
    spark.createDataFrame([("a", 5, "x"), ("b", 1705276800, "x")], payload).write.parquet(root)
    landed = spark.read.parquet(root).where(registry.PAYMENTS.stored_bound(at("2024-01-15")))
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created,1705276800)" in plan
    assert [r.id for r in landed.collect()] == ["b"]


def files_read(df):
    """How many files a plan without a shuffle has opened, once it has run."""
    df = df.select("*")  # metrics count a plan's first run
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numFiles").value()


@pytest.mark.parametrize("spec", registry.default_registry().all(), ids=lambda s: s.entity_type)
def test_days_that_landed_before_the_watermark_are_not_read(spark, root, spec):
    path = f"{root}/landing"
    for day in range(1, 11):
        modified = f"2026-01-{day:02d}T12:00:00.000Z"
        payload = {"id": f"x{day}", "updated": modified, "created": modified}
        if spec.provider == vocab.HUBSPOT:
            payload = {"id": f"x{day}", "properties": {"lastmodifieddate": modified, "hs_lastmodifieddate": modified}}
        if spec.entity_type == "payment":
            payload = intent(f"x{day}", 1767225600 + 86400 * (day - 1) + 43200)
        line = spark.createDataFrame([(json.dumps(payload),)], "value string")
        parsed = landing.parse_landed(line, "value", spec.payload).drop(landing.CORRUPT)
        landing.land(parsed, path, F.lit(f"2026-01-{day:02d}"))
    landed = landing.read_landed(spark, path, spec.payload)
    changed = spec.changed_since(landed, at("2026-01-08T12:00"))
    assert sorted(r.id for r in changed.collect()) == ["x10", "x8", "x9"]
    assert files_read(changed) == 4  # the day before too, for clocks that differ
    assert "landed_on" in changed._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1]


def test_files_written_before_the_watermark_are_not_read(spark, root):
    """A landing folder without days: Spark prunes its files by when they were written."""
    import os

    path = f"{root}/landing"
    for k in range(4):
        write(spark, path, intent(f"p{k}", 1767225600 + k * 86400))
    local = path.removeprefix("file:")
    names = {f: open(f"{local}/{f}").read() for f in os.listdir(local) if f.endswith(".txt")}
    for f, text in names.items():
        day = 1767225600 + int(json.loads(text)["id"][1:]) * 86400
        os.utime(f"{local}/{f}", (day + 3600, day + 3600))
    landed = landing.read_landed(spark, path, schemas.PAYMENT_INTENT)
    changed = registry.PAYMENTS.changed_since(landed, at("2026-01-03"))
    assert sorted(r.id for r in changed.collect()) == ["p2", "p3"]
    assert files_read(changed) == 3


def test_nothing_is_left_of_a_load_even_if_it_fails(w, landed, monkeypatch):
    """Staged rows are below the warehouse's root while a load runs, and gone after it."""
    import os

    left = lambda: os.path.isdir(f"{w.root}/_scratch") and os.listdir(f"{w.root}/_scratch")
    seen, commit = [], w.tables["payment"].commit

    def watched(*a, **k):
        seen.append(len(left()))
        if len(seen) > 1:
            raise RuntimeError("lost")
        return commit(*a, **k)

    monkeypatch.setattr(w.tables["payment"], "commit", watched)
    assert run(w, landed(intent("a", 100)), "j1").outcome == "success"
    assert seen == [1] and not left()
    result = run(w, landed(), "j2")
    assert (result.outcome, result.error) == ("failed", "lost") and not left()
    assert result.finished_at > result.started_at


def test_a_run_repeated_by_its_id_leaves_one_row_of_everything(w, landed, monkeypatch):
    """The run dies after its commit: run again it makes up for its audit rows and its log row."""
    df = landed(intent("a", 100), intent("b", 100, amount=-1))
    append = w.audit.append
    monkeypatch.setattr(w.audit, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    assert run(w, df, "j1").outcome == "failed"
    monkeypatch.setattr(w.audit, "append", append)
    result = run(w, df, "j1", NOW + timedelta(minutes=1))
    assert (result.outcome, result.records_upserted, result.records_failed) == ("partial_failure", 1, 1)
    assert rows(w.jobs.read(), "id", "outcome") == [("j1", "partial_failure")]
    assert rows(w.audit.read(), "source_id", "operation") == [("a", "created")]
    assert w.tables["payment"].commits().where("kind = 'delta'").count() == 1
    assert w.failures.read().where("error_code = 'MALFORMED_RESPONSE'").count() == 1


def test_every_micro_batch_is_one_run(w, spark, root):
    path, checkpoint = f"{root}/landing", f"{root}/checkpoint"

    def go():
        stream = landing.stream_landed(spark, path, schemas.PAYMENT_INTENT)
        stream_incremental(w, registry.PAYMENTS, stream, checkpoint).awaitTermination()

    columns = ("id", "mode", "outcome", "records_fetched", "records_upserted", "records_failed")
    write(spark, path, intent("a", 1), intent("b", 1, amount=-1))
    go()
    first = ("incremental:0", "incremental", "partial_failure", 2, 1, 1)
    assert rows(w.jobs.read(), *columns) == [first]
    write(spark, path, intent("c", 2))
    commit, table = w.tables["payment"].commit, w.tables["payment"]
    table.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(Exception, match="lost"):
        go()
    assert rows(w.jobs.read(), *columns) == [first, ("incremental:1", "incremental", "failed", 0, 0, 0)]
    assert w.failures.read().where("error_code = 'UNEXPECTED_ERROR'").count() == 1
    table.commit = commit
    go()
    assert rows(w.jobs.read(), *columns) == [first, ("incremental:1", "incremental", "success", 1, 1, 0)]


def test_rows_that_break_a_rule_of_their_table_are_rejects(w, spark, monkeypatch):
    """Rules of the table, and that the provider exists, hold whatever validation lets through."""
    from dataclasses import replace

    event = ("e", "s", None, None, "confirmed", (None, "2026-01-02", None), (None, "2026-01-03", None),
             None, None, None, None, None, None, "2026-01-01T00:00:00Z")
    late = ("f", *event[1:5], (None, "2026-01-05", None), *event[6:])
    landed_ = spark.createDataFrame([event, late], schemas.CALENDAR_EVENT)
    lax = replace(registry.CALENDAR, rules=lambda: [])
    result = run_incremental(w, lax, landed_, NOW, "j1")
    assert (result.outcome, result.records_failed) == ("partial_failure", 1)
    assert rows(w.tables["event"].read(), "source_id") == [("e",)]
    assert [r.message for r in w.failures.read().collect()] == ["Violates: event_end_after_start"]
    other = replace(lax, normalize=lambda df: registry.CALENDAR.normalize(df, "legacy"))
    assert run_incremental(w, other, landed_, NOW, "j2").records_upserted == 0
    assert {r.message for r in w.failures.read().where("job_id = 'j2'").collect()} == {
        "Violates: provider_exists", "Violates: provider_exists,event_end_after_start",
    }


@pytest.mark.parametrize("table", ["job_history", "canonical_record_audit", "webhook_events", "payment_status_mappings"])
def test_other_tables_take_no_row_that_breaks_a_rule(w, spark, table):
    log = {"job_history": w.jobs, "canonical_record_audit": w.audit}.get(table)
    keyed = {"webhook_events": w.webhook_events, "payment_status_mappings": w.mapping_edits}.get(table)
    schema = (log or keyed).schema
    row = [None if f.name not in ("idempotency_key", "raw_status", "provider", "mode") else "x" for f in schema.fields]
    column = {"job_history": "outcome", "canonical_record_audit": "operation", "webhook_events": "processing_status",
              "payment_status_mappings": "canonical_status"}[table]
    row[schema.names.index(column)] = "nonsense"
    bad = spark.createDataFrame([tuple(row)], schema)
    with pytest.raises(Exception, match=f"{table} violates"):
        log.append(bad, "b") if log else keyed.commit(bad, NOW)
    assert (log or keyed).read().count() == 0


def test_an_edit_of_the_mapping_is_used_by_the_next_micro_batch(w, spark, root):
    """Edited through one session and warehouse, seen by a stream of another."""
    path, checkpoint = f"{root}/landing", f"{root}/checkpoint"

    def go():
        stream = landing.stream_landed(spark, path, schemas.PAYMENT_INTENT)
        stream_incremental(w, registry.PAYMENTS, stream, checkpoint).awaitTermination()
        return rows(w.tables["payment"].read(), "source_id", "canonical_status")

    write(spark, path, intent("a", 1, status="settled"))
    assert go() == [("a", "unknown")]
    elsewhere = Warehouse(spark.newSession(), w.root)
    word = "provider string, raw_status string, canonical_status string"
    elsewhere.edit_mapping(elsewhere.spark.createDataFrame([("stripe", "settled", "collected")], word), NOW)
    write(spark, path, intent("b", 1, status="settled"), intent("c", 1))
    assert go() == [("a", "unknown"), ("b", "collected"), ("c", "collected")]
    with pytest.raises(Exception):
        elsewhere.edit_mapping(elsewhere.spark.createDataFrame([("stripe", "settled", "paid")], word), NOW)
    with pytest.raises(Exception, match="bad payment status mapping"):
        elsewhere.edit_mapping(elsewhere.spark.createDataFrame([("nobody", "settled", "collected")], word), NOW)
    assert w.mapping.where("raw_status = 'settled'").first().canonical_status == "collected"
