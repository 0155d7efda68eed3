"""Run health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revsync import schemas, session
from revsync.operators import health as ops, lookups
from revsync.plans.catalog import quality  # noqa: F401  (defines the job_outcomes view)
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.inputs import Inputs
from revsync.plans.store import Log


def _jobs(t: Inputs) -> DataFrame:
    return ops.with_outcome(t["job_history"])


CHECK_VIEWS["classified"] = """
select *, case when http_status is null then 'PROVIDER_TIMEOUT'
  when http_status in (401, 403) then 'AUTHENTICATION_EXPIRED'
  when http_status = 410 then 'INVALID_CURSOR' when http_status = 429 then 'RATE_LIMITED'
  when http_status >= 500 then 'PROVIDER_UNAVAILABLE'
  when http_status >= 400 then 'MALFORMED_RESPONSE' end as error_code
from {fetch_log}"""
CHECK_VIEWS["failures"] = """
select provider, entity_type, job_id, error_code, concat(operation, ' failed with status ',
  coalesce(cast(http_status as varchar), 'none')) as message, occurred_at
from {classified} where error_code is not null and not (attempt < 5
  and (http_status is null or http_status = 429 or http_status >= 500))"""
CHECK_VIEWS["last_runs"] = """
select provider, entity_type, outcome as last_sync_status, mode as last_sync_mode,
  started_at as last_sync_started_at, finished_at as last_sync_completed_at,
  records_upserted as records_processed_last_run
from (select *, row_number() over (partition by provider, entity_type
  order by started_at desc, id desc) as rn from {job_outcomes}) where rn = 1"""
CHECK_VIEWS["last_ok"] = """
select provider, entity_type, started_at as ok_at, id as ok_id, finished_at
from (select *, row_number() over (partition by provider, entity_type
  order by started_at desc, id desc) as rn from {job_outcomes} where outcome = 'success')
where rn = 1"""
CHECK_VIEWS["since_ok"] = """
select j.provider, j.entity_type, cast(count(*) filter (where o.ok_at is null
  or j.started_at > o.ok_at or (j.started_at = o.ok_at and j.id > o.ok_id)) as bigint)
  as consecutive_failure_count
from {job_outcomes} j left join {last_ok} o
  on o.provider = j.provider and o.entity_type = j.entity_type
group by 1, 2"""
CHECK_VIEWS["status_rows"] = """
select r.*, o.finished_at as last_successful_sync_at
from {last_runs} r left join {last_ok} o
  on o.provider = r.provider and o.entity_type = r.entity_type"""


@query(
    "run_outcome",
    """
select provider, entity_type, outcome, cast(count(*) as bigint) as runs,
  cast(sum(records_fetched) as bigint) as fetched, cast(sum(records_upserted) as bigint) as upserted,
  cast(sum(records_failed) as bigint) as failed
from {job_outcomes} group by 1, 2, 3""",
)
def run_outcome(t: Inputs) -> DataFrame:
    return (
        _jobs(t)
        .groupBy("provider", "entity_type", "outcome")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("records_fetched").alias("fetched"),
            F.sum("records_upserted").alias("upserted"),
            F.sum("records_failed").alias("failed"),
        )
    )


@query("sync_status", "select * from {status_rows}")
def sync_status(t: Inputs) -> DataFrame:
    return ops.sync_status(_jobs(t))


@query("consecutive_failures", "select * from {since_ok}")
def consecutive_failures(t: Inputs) -> DataFrame:
    return ops.consecutive_failures(_jobs(t))


@query(
    "list_sync_status",
    "select * from {status_rows} join {since_ok} using (provider, entity_type)",
)
def list_sync_status(t: Inputs) -> DataFrame:
    return ops.list_sync_status(_jobs(t))


@query(
    "recent_jobs",
    """
select id, provider, entity_type, mode, outcome, started_at, finished_at from {job_outcomes}
order by started_at desc, id desc limit 50""",
)
def recent_jobs(t: Inputs) -> DataFrame:
    jobs = _jobs(t).select(
        "id", "provider", "entity_type", "mode", "outcome", "started_at", "finished_at"
    )
    return ops.recent_jobs(jobs)


@query(
    "recent_failures",
    """
select * from {failures}
order by occurred_at desc, provider, entity_type, error_code, job_id, message limit 50""",
)
def recent_failures(t: Inputs) -> DataFrame:
    return ops.recent_failures(ops.fetch_failures(t["fetch_log"]).drop("context"))


@query(
    "sink_jobs",
    """
select id, provider, entity_type, mode, outcome, started_at, finished_at,
  cast(records_fetched as bigint) as records_fetched,
  cast(records_upserted as bigint) as records_upserted,
  cast(records_failed as bigint) as records_failed
from {job_outcomes}""",
)
def sink_jobs(t: Inputs) -> DataFrame:
    """Finished runs appended to the run log and read back."""
    log = Log(t.spark, session.new_scratch(t.spark, "job-history"), schemas.JOB_HISTORY)
    counters = ["records_fetched", "records_upserted", "records_failed"]
    log.append(
        _jobs(t)
        .withColumns({c: F.col(c).cast("bigint") for c in counters})
        .withColumn("fell_back", F.lit(False))
        .withColumn("error_summary", F.lit(None).cast("string"))
    )
    return log.read().drop("fell_back", "error_summary")


@query(
    "failures_by_job",
    """
select f.provider, f.entity_type, f.job_id, f.error_code, f.occurred_at, j.mode as job_mode,
  j.started_at as job_started_at
from {failures} f left join {job_history} j on j.id = f.job_id""",
)
def failures_by_job(t: Inputs) -> DataFrame:
    failures = ops.fetch_failures(t["fetch_log"]).drop("context", "message")
    return lookups.failures_by_job(failures, t["job_history"])


_BOUNDS = ["0.1", "0.5", "1", "5", "15", "30", "60", "120", "300", "900", "+Inf"]


@query(
    "duration_histogram",
    " union all ".join(
        f"""
select provider, entity_type, mode, outcome, '{b}' as le,
  cast(count(*) filter (where {"true" if b == "+Inf" else f"duration_seconds <= {b}"}) as bigint)
    as observations,
  round(sum(duration_seconds), 3) as sum_seconds, cast(count(*) as bigint) as runs
from {{job_outcomes}} group by 1, 2, 3, 4"""
        for b in _BOUNDS
    ),
)
def duration_histogram(t: Inputs) -> DataFrame:
    return ops.duration_histogram(_jobs(t)).withColumn(
        "sum_seconds", F.round("sum_seconds", 3)
    )


@query(
    "retry_counts",
    """
select provider, entity_type, operation, cast(count(*) as bigint) as retries
from {classified} where error_code in ('PROVIDER_TIMEOUT', 'RATE_LIMITED', 'PROVIDER_UNAVAILABLE')
  and attempt < 5 group by 1, 2, 3""",
)
def retry_counts(t: Inputs) -> DataFrame:
    return ops.retry_counts(t["fetch_log"])


@query(
    "failure_counts",
    """
select provider, entity_type, error_code, cast(count(*) as bigint) as failures
from {failures} group by 1, 2, 3""",
)
def failure_counts(t: Inputs) -> DataFrame:
    return ops.failure_counts(ops.fetch_failures(t["fetch_log"]))
