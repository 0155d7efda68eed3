import random

import pytest
from helpers import at, rows

from revsync.operators import health, lookups

JOB = "id string, provider string, entity_type string, mode string, outcome string, started_at timestamp_ntz, finished_at timestamp_ntz, records_upserted bigint"
OUTCOMES = ["success", "partial_failure", "failed"]


def test_status_against_a_snapshot_kept_in_place(spark):
    """Run by run, as a snapshot row would be overwritten."""
    rng, data, snap = random.Random(5), [], {}
    for i in range(400):
        source = ("hubspot", rng.choice(["contact", "deal"])) if i % 3 else ("stripe", "payment")
        start = at(f"2026-01-{1 + i // 20:02d}T{i % 20:02d}:00")
        outcome = rng.choice(OUTCOMES + ["failed"] * 4) if source[1] != "deal" else "failed"
        data.append((f"j{i:04d}", *source, "full", outcome, start, start.replace(minute=5), i))
        old = snap.get(source, (None, 0))
        ok = outcome == "success"
        snap[source] = (data[-1][6] if ok else old[0], 0 if ok else old[1] + 1, data[-1])
    jobs = spark.createDataFrame(data, JOB)
    got = {(r.provider, r.entity_type): r for r in health.list_sync_status(jobs).collect()}
    assert set(got) == set(snap)
    for source, (last_ok, failures, job) in snap.items():
        r = got[source]
        assert (r.last_successful_sync_at, r.consecutive_failure_count) == (last_ok, failures)
        assert (r.last_sync_status, r.last_sync_started_at) == (job[4], job[5])
        assert r.records_processed_last_run == job[7]


def test_reports_are_limited_and_filtered(spark):
    data = [
        (f"j{i:03d}", "stripe" if i % 2 else "hubspot", "payment", "full", "success",
         at("2026-01-01"), at("2026-01-01"), 0)
        for i in range(120)
    ]
    jobs = spark.createDataFrame(data, JOB)
    got = [r.id for r in health.recent_jobs(jobs).collect()]
    assert len(got) == 50 and got[0] == "j119"
    assert {r.provider for r in health.recent_jobs(jobs, "stripe", limit=500).collect()} == {"stripe"}
    for bad in (0, 501):
        with pytest.raises(ValueError):
            health.recent_jobs(jobs, limit=bad)
    plan = health.recent_jobs(jobs)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_durations_are_cumulative(spark):
    df = spark.createDataFrame(
        [("p", "e", "full", "success", d) for d in (0.05, 0.1, 0.3, 20.0, 1000.0)],
        "provider string, entity_type string, mode string, outcome string, duration_seconds double",
    )
    got = {r.le: r.observations for r in health.duration_histogram(df).collect()}
    assert got == {
        "0.1": 2, "0.5": 3, "1": 3, "5": 3, "15": 3, "30": 4, "60": 4, "120": 4, "300": 4,
        "900": 4, "+Inf": 5,
    }


def test_retries_stop_at_the_last_attempt(spark):
    df = spark.createDataFrame(
        [("p", "e", "fetch", a, s) for a, s in [(1, 429), (2, 500), (5, 503), (1, 401), (1, 200), (3, None)]],
        "provider string, entity_type string, operation string, attempt int, http_status int",
    )
    assert rows(health.retry_counts(df)) == [("p", "e", "fetch", 3)]


def test_failures_keep_without_their_job(spark):
    failures = spark.createDataFrame([("j1", "x"), ("gone", "y"), (None, "z")], "job_id string, error_code string")
    jobs = spark.createDataFrame(
        [("j1", "full", at("2026-01-01"))], "id string, mode string, started_at timestamp_ntz"
    )
    got = rows(lookups.failures_by_job(failures, jobs), "error_code", "job_mode")
    assert got == [("x", "full"), ("y", None), ("z", None)]


def test_failures_are_the_calls_that_ended_a_run(spark):
    calls = [
        ("a", 500, 1, "full"), ("a", 500, 5, "full"), ("b", None, 4, "full"), ("c", 401, 1, "full"),
        ("d", 410, 1, "incremental"), ("e", 410, 1, "full"), ("f", 200, 1, "full"), ("g", 404, 2, None),
    ]
    log = spark.createDataFrame(
        [(j, "hubspot", "deal", "fetch", n, s, m, at("2026-01-01")) for j, s, n, m in calls],
        "job_id string, provider string, entity_type string, operation string, attempt int, "
        "http_status int, mode string, occurred_at timestamp_ntz",
    )
    assert rows(health.fetch_failures(log), "job_id") == [("a",), ("c",), ("e",), ("g",)]
    assert rows(health.fetch_failures(log.drop("mode")), "job_id")[2] == ("d",)


def test_histogram_of_the_run_log_itself(spark, root):
    from revsync.plans.warehouse import Warehouse

    w = Warehouse(spark, root)
    start = at("2026-01-01")
    job = ("j", "hubspot", "deal", "full", "success", start, start.replace(second=7), 1, 1, 0, False, None)
    w.jobs.append(spark.createDataFrame([job], w.jobs.schema))
    got = {r.le: r.observations for r in health.duration_histogram(w.jobs.read()).collect()}
    assert got["5"] == 0 and got["15"] == 1 and got["+Inf"] == 1
