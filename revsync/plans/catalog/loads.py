"""Incremental loads, end to end, into tables on disk."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from revsync import session
from revsync.operators import normalize, status
from revsync.plans import inputs
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.incremental import run_incremental
from revsync.plans.inputs import Inputs
from revsync.plans.warehouse import Warehouse
from revsync.sources.registry import PAYMENTS

FIRST = datetime(2024, 1, 15)
T1 = datetime(2024, 2, 1, 12)
T2 = T1 + timedelta(hours=1)

# One payment provider's landed payments; some are rejects.
CHECK_VIEWS["landed_payments"] = """
select *, normalize_error is null and issue_text = '' as ok, b.occurred_at as created
from {bad_payments_all} a join {bad_payments} b on b.id = a.source_id"""
CHECK_VIEWS["first_load"] = """
select cast(count(*) as bigint) as records_fetched,
  cast(count(*) filter (where ok) as bigint) as records_upserted,
  cast(count(*) filter (where not ok) as bigint) as records_failed, max(created) as mark
from {landed_payments} where created < timestamp '2024-01-15 00:00:00'"""


def _job_rows(second_mode: str, second_where: str, fell_back: str) -> str:
    return f"""
select 'first' as id, 'full' as mode,
  case when records_failed = 0 then 'success' when records_upserted > 0 then 'partial_failure'
    else 'failed' end as outcome,
  records_fetched, records_upserted, records_failed, false as fell_back
from {{first_load}}
union all
select 'second', '{second_mode}',
  case when failed = 0 then 'success' when upserted > 0 then 'partial_failure' else 'failed' end,
  fetched, upserted, failed, {fell_back}
from (select cast(count(*) as bigint) as fetched,
    cast(count(*) filter (where p.ok and p.created >= timestamp '2024-01-15 00:00:00') as bigint)
      as upserted,
    cast(count(*) filter (where not p.ok) as bigint) as failed
  from {{landed_payments}} p, {{first_load}} f where {second_where})"""


def _two_loads(t: Inputs, retained_from: datetime | None) -> Warehouse:
    """A first load of what had landed by then, and a second of everything."""
    root = session.new_scratch(t.spark, "warehouse")
    w = Warehouse(t.spark, root, t["status_map"])
    landed = inputs.payment_payloads(t["bad_payments"])
    by_then = inputs.payment_payloads(t["bad_payments"].where(F.col("occurred_at") < F.lit(str(FIRST))))
    run_incremental(w, PAYMENTS, by_then, T1, "first")
    run_incremental(w, PAYMENTS, landed, T2, "second", retained_from=retained_from)
    return w


def _jobs(w: Warehouse) -> DataFrame:
    return w.jobs.read().select(
        "id", "mode", "outcome", "records_fetched", "records_upserted", "records_failed",
        "fell_back",
    )


@query("incremental_load", _job_rows("incremental", "p.created >= f.mark", "false"))
def incremental_load(t: Inputs) -> DataFrame:
    """The run log of a full load and the incremental one after it."""
    return _jobs(_two_loads(t, None))


@query("fallback_full", _job_rows("full", "true", "true"))
def fallback_full(t: Inputs) -> DataFrame:
    """As before, but the watermark is older than what is still landed."""
    return _jobs(_two_loads(t, T1))


@query(
    "remap_payments",
    """
select provider, source_id, raw_status, 'pending' as canonical_status from {canonical_payments}
where lower(trim(raw_status)) = 'paid'
union all
select provider, source_id, raw_status, canonical_status from {canonical_payments}
where lower(trim(raw_status)) <> 'paid'""",
)
def remap_payments(t: Inputs) -> DataFrame:
    """Stored payments after an operator edits the mapping."""
    provider = F.col("provider")
    stored = normalize.normalize_payments(
        inputs.payment_payloads(t["raw_payments"]), t["status_map"], provider
    )
    paid = F.col("raw_status") == "paid"
    edited = t["status_map"].withColumn(
        "canonical_status", F.when(paid, "pending").otherwise(F.col("canonical_status"))
    )
    both = edited.unionByName(
        t.spark.sql("select 'stripe' provider, 'paid' raw_status, 'pending' canonical_status")
    )
    return status.remap(stored, both).select(
        "provider", "source_id", "raw_status", "canonical_status"
    )
