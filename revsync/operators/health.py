"""Run health: status per source, recent runs and failures, counters and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from revsync import vocab
from revsync.functions import outcomes
from revsync.operators import filters

SOURCE = ["provider", "entity_type"]


def with_outcome(jobs: DataFrame) -> DataFrame:
    """Runs with their outcome, judged from their counters."""
    return jobs.withColumn(
        "outcome", outcomes.run_outcome(F.col("records_upserted"), F.col("records_failed"))
    )


def _position() -> Column:
    """When a run started; its id settles ties."""
    return F.struct("started_at", "id")


def _succeeded() -> Column:
    return F.col("outcome") == vocab.SUCCESS


def daily_states(jobs: DataFrame) -> DataFrame:
    """One row per source and day that has what its status needs: states of days combine.

    A day's last run, its last success, its runs and those after that success.
    """
    position, started = _position(), F.col("started_at")
    day = Window.partitionBy(*SOURCE, "day")
    newest_first = day.orderBy(F.desc("started_at"), F.desc("id"))
    rows = jobs.select(
        *SOURCE, "id", "started_at", "finished_at", "outcome", "mode", "records_upserted",
        F.date_trunc("day", started).alias("day"),
    ).withColumn("_ok_since", F.count(F.when(_succeeded(), 1)).over(newest_first))
    last = F.struct("outcome", "mode", "started_at", "finished_at", "records_upserted")
    succeeded = F.when(_succeeded(), position)
    return rows.groupBy(*SOURCE, "day").agg(
        F.max(position).alias("last_at"),
        F.max_by(last, position).alias("last"),
        F.max(succeeded).alias("ok_at"),
        F.max_by("finished_at", succeeded).alias("ok_finished_at"),
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("_ok_since") == 0, 1)).alias("runs_after_ok"),
    )


def list_sync_status(jobs: DataFrame) -> DataFrame:
    """The whole status table: each source's latest run, last success and runs since then.

    The run log is read once. Its runs meet by source and day; what meets by source is a
    row a day.
    """
    ok_day = F.max(F.when(F.col("ok_at").isNotNull(), F.col("day"))).over(Window.partitionBy(*SOURCE))
    after = (
        F.when(F.col("_ok_day").isNull() | (F.col("day") > F.col("_ok_day")), F.col("runs"))
        .when(F.col("day") == F.col("_ok_day"), F.col("runs_after_ok"))
        .otherwise(0)
    )
    return (
        daily_states(jobs)
        .withColumn("_ok_day", ok_day)
        .groupBy(*SOURCE)
        .agg(
            F.max_by("last", "last_at").alias("_last"),
            F.max_by("ok_finished_at", "ok_at").alias("last_successful_sync_at"),
            F.sum(after).alias("consecutive_failure_count"),
        )
        .select(
            *SOURCE,
            F.col("_last.outcome").alias("last_sync_status"),
            F.col("_last.mode").alias("last_sync_mode"),
            F.col("_last.started_at").alias("last_sync_started_at"),
            F.col("_last.finished_at").alias("last_sync_completed_at"),
            "last_successful_sync_at",
            F.col("_last.records_upserted").alias("records_processed_last_run"),
            "consecutive_failure_count",
        )
    )


def sync_status(jobs: DataFrame) -> DataFrame:
    """The latest run of every source, and when it last succeeded."""
    return list_sync_status(jobs).drop("consecutive_failure_count")


def consecutive_failures(jobs: DataFrame) -> DataFrame:
    """Runs since the last success, partial failures included."""
    return list_sync_status(jobs).select(*SOURCE, "consecutive_failure_count")


def _limit(limit: int) -> int:
    if not 1 <= limit <= vocab.MAX_REPORT_LIMIT:
        raise ValueError(f"limit must lie between 1 and {vocab.MAX_REPORT_LIMIT}")
    return limit


def recent_jobs(
    jobs: DataFrame,
    provider: str | None = None,
    entity_type: str | None = None,
    limit: int = vocab.DEFAULT_REPORT_LIMIT,
) -> DataFrame:
    kept = filters.provider_entity_filter(jobs, provider, entity_type)
    return kept.orderBy(F.desc("started_at"), F.desc("id")).limit(_limit(limit))


def recent_failures(
    failures: DataFrame,
    provider: str | None = None,
    entity_type: str | None = None,
    limit: int = vocab.DEFAULT_REPORT_LIMIT,
) -> DataFrame:
    kept = filters.provider_entity_filter(failures, provider, entity_type)
    ties = [F.asc(c) for c in ("provider", "entity_type", "error_code", "job_id", "message")]
    return kept.orderBy(F.desc("occurred_at"), *ties).limit(_limit(limit))


def duration_histogram(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cumulative duration buckets with sum and count, one pass over the runs.

    A run's duration is its `duration_seconds`, or else the time from start to finish.
    """
    keys = keys or [*SOURCE, "mode", "outcome"]
    if "duration_seconds" in jobs.columns:
        d = F.col("duration_seconds")
    else:
        micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("finished_at", "started_at")]
        d = (micros[0] - micros[1]) / 1e6
    bounds = [str(b) for b in vocab.DURATION_BUCKETS]
    counts = [F.count(F.when(d <= float(b), 1)).alias(f"le_{b}") for b in bounds]
    wide = jobs.groupBy(*keys).agg(
        *counts,
        F.count(F.lit(1)).alias("le_+Inf"),
        F.sum(d).alias("sum_seconds"),
        F.count(F.lit(1)).alias("runs"),
    )
    pairs = ", ".join(f"'{b}', `le_{b}`" for b in [*bounds, "+Inf"])
    return wide.selectExpr(
        *keys, f"stack({len(bounds) + 1}, {pairs}) as (le, observations)", "sum_seconds", "runs"
    )


def classified_fetches(fetch_log: DataFrame) -> DataFrame:
    """Provider calls with the error they stand for and what that error asks for."""
    rows = fetch_log.withColumn("error_code", outcomes.error_code(F.col("http_status")))
    code = F.col("error_code")
    return rows.select(
        "*",
        outcomes.retryable(code).alias("retryable"),
        outcomes.requires_full_resync(code).alias("requires_full_resync"),
        outcomes.fatal_for_run(code).alias("fatal_for_run"),
    )


def fetch_failures(fetch_log: DataFrame, max_attempts: int = 5) -> DataFrame:
    """The calls that ended their run, as failure log rows.

    A call that is tried again is no failure. Nor is one that makes an incremental run (by
    the log's `mode`, where it has one) start over in full.
    """
    rows = classified_fetches(fetch_log)
    failed = rows.where(
        F.col("error_code").isNotNull()
        & ~(F.col("retryable") & (F.col("attempt") < max_attempts))
    )
    if "mode" in rows.columns:
        resync = F.col("requires_full_resync") & F.col("mode").eqNullSafe(vocab.INCREMENTAL)
        failed = failed.where(~resync)
    return failed.select(
        "provider",
        "entity_type",
        "job_id",
        "error_code",
        F.concat(
            F.col("operation"),
            F.lit(" failed with status "),
            F.coalesce(F.col("http_status").cast("string"), F.lit("none")),
        ).alias("message"),
        F.to_json(F.struct("error_code", "retryable", "requires_full_resync", "fatal_for_run"))
        .alias("context"),
        "occurred_at",
    )


def retry_counts(fetch_log: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Calls that were tried again: retryable failures with attempts left."""
    again = classified_fetches(fetch_log).where(
        F.col("retryable") & (F.col("attempt") < max_attempts)
    )
    return again.groupBy(*SOURCE, "operation").agg(F.count(F.lit(1)).alias("retries"))


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy(*SOURCE, "error_code").agg(F.count(F.lit(1)).alias("failures"))
