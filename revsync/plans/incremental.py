"""One load of one source: mode, scan, normalise, validate, upsert, commit, report."""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from revsync import schemas, session, vocab
from revsync.operators import normalize, upsert, validate
from revsync.plans.store import Commit, Cursor
from revsync.plans.warehouse import Warehouse
from revsync.sources.registry import SourceSpec

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    job_id: str
    provider: str
    entity_type: str
    mode: str
    outcome: str
    records_fetched: int
    records_upserted: int
    records_failed: int
    fell_back: bool
    started_at: datetime
    finished_at: datetime
    commit: Commit | None = None
    error: str | None = None


def choose_mode(cursor: Cursor | None, now: datetime, max_age: timedelta) -> str:
    """Incremental from a usable cursor, else full."""
    if cursor is None:
        return vocab.FULL
    if cursor.expires_at is not None and now >= cursor.expires_at:
        return vocab.FULL
    return vocab.FULL if now - cursor.issued_at > max_age else vocab.INCREMENTAL


def token_time(spark: SparkSession, spec: SourceSpec, token: str) -> datetime | None:
    return spark.range(1).select(spec.token_time(F.lit(token))).first()[0]


def normalized(spec: SourceSpec, landed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical rows, with the payload's own watermark."""
    landed = landed.withColumn("watermark", spec.watermark())
    if spec.needs_status_map:
        return spec.normalize(landed, mapping)
    return spec.normalize(landed)


def load_rows(
    warehouse: Warehouse,
    spec: SourceSpec,
    landed: DataFrame,
    job_id: str,
    now: datetime,
    cursor_for=None,
    batch_id: str | None = None,
    policy: str = "arrival",
) -> tuple[Commit, int, int]:
    """Normalise, validate and commit landed payloads; returns the commit, fetched and failed.

    The payloads are scanned once: the normalised rows go to a staged table split by
    verdict, Spark observes their counts and watermark on the way, and rejects and upsert
    read that table. A row that breaks a rule of its table, or whose provider does not
    exist, is a reject like one that fails validation. Rejects are logged before the commit
    and changes after it, each as the batch's own, so that a repeated batch leaves them as
    they are and one that died half-way makes up for them.
    """
    with session.scratch(warehouse.spark, warehouse.root) as path:
        return _load(
            warehouse, spec, landed, job_id, now, cursor_for, batch_id, policy, f"{path}/rows"
        )


def _judged(warehouse: Warehouse, spec: SourceSpec, rows: DataFrame) -> DataFrame:
    """Rows with their verdict, and `broken`: the rules of the table that each breaks."""
    rules, table = spec.rules(), warehouse.names[spec.entity_type]
    known = warehouse.providers.select(F.col("provider").alias("_known"))
    rows = rows.join(known, F.col("provider") == F.col("_known"), "left")
    exists = F.when(F.col("_known").isNull(), vocab.PROVIDER_EXISTS)
    names = [F.when(broken, name) for name, broken in validate.check_rules(table)]
    ok = validate.is_valid(rules)
    keeps = F.col("broken") == ""
    return (
        rows.withColumn("broken", F.concat_ws(",", exists, *names))
        .drop("_known")
        .select(
            "*",
            (ok & keeps).alias("is_valid"),
            F.when(~ok, validate.reject_message(rules))
            .when(~keeps, F.concat(F.lit(vocab.VIOLATES), "broken")).alias("reject_message"),
            F.when(~ok, validate.issues(rules)).alias("issues"),
        )
    )


def _load(
    warehouse, spec, landed, job_id, now, cursor_for, batch_id, policy, path
) -> tuple[Commit, int, int]:
    spark = warehouse.spark
    table, name = warehouse.tables[spec.entity_type], warehouse.names[spec.entity_type]
    rows = normalized(spec, landed, warehouse.mapping)
    judged = _judged(warehouse, spec, normalize.stamp_synced_at(rows, now))
    seen = Observation(f"load-{uuid.uuid4().hex}")
    watched = judged.observe(
        seen,
        F.count(F.lit(1)).alias("fetched"),
        F.count(F.when(~F.col("is_valid"), 1)).alias("failed"),
        spec.token(F.max("watermark")).alias("token"),
        *[
            F.count(F.when(broken, 1)).alias(rule)
            for rule, broken in validate.check_rules(name)
        ],
    )
    watched.write.partitionBy("is_valid").parquet(path)
    staged = spark.read.schema(judged.schema).parquet(path)
    counts = seen.get
    for rule, _ in validate.check_rules(name):
        if counts[rule]:
            log.warning("%s: %d rows break %s", name, counts[rule], rule)

    order = [c for c in ("arrival_seq", "landed_at", "landed_file") if c in staged.columns]
    log_id = f"{spec.entity_type}:{batch_id or uuid.uuid4().hex}"
    if counts["failed"]:
        rejects = validate.failure_rows(staged.where("not is_valid"), spec.entity_type, job_id, now)
        append_failures(warehouse, rejects, log_id)
    commit = table.commit(
        staged.where("is_valid"),
        now,
        cursor=cursor_for(counts["token"]) if cursor_for else None,
        batch_id=batch_id,
        order=[*order, "source_updated_at", "raw"],
        policy=policy,
    )
    warehouse.audit.append(
        upsert.audit_rows(table.changes(commit.version), spec.entity_type, job_id, now), log_id
    )
    return commit, counts["fetched"], counts["failed"]


def append_failures(warehouse: Warehouse, rows: DataFrame, batch_id: str | None = None) -> None:
    """Failures are logged as well as can be; not being able to never fails a load."""
    try:
        if not rows.isEmpty():
            warehouse.failures.append(rows, batch_id)
    except Exception:  # noqa: BLE001
        log.exception("could not write the failure log")


def run_incremental(
    warehouse: Warehouse,
    spec: SourceSpec,
    landed: DataFrame,
    now: datetime,
    job_id: str,
    max_age: timedelta = timedelta(hours=vocab.CURSOR_MAX_AGE_HOURS),
    retained_from: datetime | None = None,
    policy: str = "arrival",
) -> RunResult:
    """Bring a source's table up to date from its landed payloads.

    Starts at the stored watermark (inclusive) while the cursor is usable, else reads
    everything. A watermark from before `retained_from`, the earliest payloads still
    landed, can no longer be continued: the cursor is dropped and the load is full.

    `job_id` names one run. Running it again after a crash completes what it left undone, and
    leaves one row in the run log; what it has committed is not committed twice.
    """
    spark = session.prepare(warehouse.spark)
    began = time.monotonic()
    table = warehouse.tables[spec.entity_type]
    cursor = table.cursor(*spec.key)
    mode = choose_mode(cursor, now, max_age)
    fell_back = False
    try:
        since = token_time(spark, spec, cursor.token) if mode == vocab.INCREMENTAL else None
        if since is not None and retained_from is not None and since < retained_from:
            log.warning("%s/%s: watermark predates landed data; loading in full", *spec.key)
            table.clear_cursor(*spec.key, now)
            mode, cursor, since, fell_back = vocab.FULL, None, None, True
        scan = landed if since is None else spec.changed_since(landed, since)

        def next_cursor(seen: str | None) -> Cursor:
            prior = cursor.token if since is not None else spec.empty_token
            token = prior if seen is None else _later(spark, spec, prior, seen)
            return Cursor(*spec.key, token, now)

        commit, fetched, failed = load_rows(
            warehouse, spec, scan, job_id, now, next_cursor, batch_id=job_id, policy=policy
        )
        outcome = _outcome(commit.upserted, failed)
        result = RunResult(
            job_id, *spec.key, mode, outcome, fetched, commit.upserted, failed, fell_back,
            now, _after(now, began), commit,
        )
    except Exception as e:  # noqa: BLE001 - a failing source must not stop the others
        log.exception("load of %s/%s failed", *spec.key)
        message = str(e).split("\n", 1)[0]
        result = RunResult(
            job_id, *spec.key, mode, vocab.FAILED, 0, 0, 0, fell_back, now, _after(now, began), None, message
        )
        append_failures(warehouse, run_failure(spark, result), _run_id(result))
    append_job(warehouse, result)
    return result


def _after(start: datetime, began: float) -> datetime:
    """The time now, on the clock that said `start` when the monotonic one said `began`."""
    return start + timedelta(seconds=time.monotonic() - began)


def _later(spark: SparkSession, spec: SourceSpec, a: str, b: str) -> str:
    later = F.greatest(spec.token_time(F.lit(a)), spec.token_time(F.lit(b)))
    return spark.range(1).select(spec.token(later)).first()[0]


def _outcome(upserted: int, failed: int) -> str:
    if failed == 0:
        return vocab.SUCCESS
    return vocab.PARTIAL_FAILURE if upserted > 0 else vocab.FAILED


def run_failure(spark: SparkSession, r: RunResult) -> DataFrame:
    row = (r.provider, r.entity_type, r.job_id, "UNEXPECTED_ERROR", r.error, "{}", r.finished_at)
    return spark.createDataFrame([row], schemas.FAILURE_LOGS)


def append_job(warehouse: Warehouse, r: RunResult) -> None:
    """One row per run, whether it is run once or again."""
    row = (
        r.job_id, r.provider, r.entity_type, r.mode, r.outcome, r.started_at, r.finished_at,
        r.records_fetched, r.records_upserted, r.records_failed, r.fell_back, r.error,
    )
    warehouse.jobs.append(warehouse.spark.createDataFrame([row], schemas.JOB_HISTORY), _run_id(r))


def _run_id(r: RunResult) -> str:
    return f"{r.provider}:{r.entity_type}:{r.job_id}"


def run_batch(
    warehouse: Warehouse,
    spec: SourceSpec,
    landed: DataFrame,
    batch_id: str,
    now: datetime,
    policy: str = "arrival",
) -> RunResult:
    """Load a stream's micro-batch as a run of its own, logged like any other.

    One that fails is logged as failed and fails the stream; its replay, which has the same
    id, takes the place of that row.
    """
    began = time.monotonic()

    def result(outcome, fetched=0, upserted=0, failed=0, commit=None, error=None):
        return RunResult(
            batch_id, *spec.key, vocab.INCREMENTAL, outcome, fetched, upserted, failed, False,
            now, _after(now, began), commit, error,
        )

    try:
        commit, fetched, failed = load_rows(
            warehouse, spec, landed, batch_id, now, batch_id=batch_id, policy=policy
        )
    except Exception as e:
        done = result(vocab.FAILED, error=str(e).split("\n", 1)[0])
        append_failures(warehouse, run_failure(warehouse.spark, done), _run_id(done))
        append_job(warehouse, done)
        raise
    done = result(_outcome(commit.upserted, failed), fetched, commit.upserted, failed, commit)
    append_job(warehouse, done)
    return done
