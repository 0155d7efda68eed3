"""Webhook deliveries as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revsync import vocab
from revsync.operators import deliveries as ops, lookups
from revsync.plans import inputs
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.inputs import Inputs
from revsync.sources.registry import CONTACTS, PAYMENTS, Registry

CHECK_VIEWS["delivery_outcomes"] = """
select *, case when coalesce(ok_before, false) then 'duplicate_skipped'
  when process_ok then 'processed' else 'failed' end as outcome,
  case when coalesce(ok_before, false) then 'processed'
    when attempt_no > 1 then 'failed' end as prior_status
from (select *, bool_or(process_ok) over (partition by idempotency_key
    order by received_at, attempt rows between unbounded preceding and 1 preceding) as ok_before,
  row_number() over (partition by idempotency_key order by received_at, attempt) as attempt_no
  from {deliveries})"""


@query(
    "webhook_outcomes",
    "select provider, idempotency_key, event_type, attempt, received_at, outcome "
    "from {delivery_outcomes}",
)
def webhook_outcomes(t: Inputs) -> DataFrame:
    return ops.webhook_outcomes(t["deliveries"]).drop("process_ok")


@query(
    "delivery_sequence",
    "select idempotency_key, attempt, attempt_no, prior_status, outcome from {delivery_outcomes}",
)
def delivery_sequence(t: Inputs) -> DataFrame:
    return ops.delivery_sequence(t["deliveries"]).select(
        "idempotency_key", "attempt", "attempt_no", "prior_status", "outcome"
    )


@query(
    "webhook_duplicate_counts",
    "select provider, cast(count(*) as bigint) as duplicates from {delivery_outcomes} "
    "where outcome = 'duplicate_skipped' group by 1",
)
def webhook_duplicate_counts(t: Inputs) -> DataFrame:
    return ops.duplicate_counts(ops.webhook_outcomes(t["deliveries"]))


@query(
    "webhook_outcome_counts",
    "select provider, outcome, cast(count(*) as bigint) as deliveries from {delivery_outcomes} "
    "where outcome <> 'duplicate_skipped' group by 1, 2",
)
def webhook_outcome_counts(t: Inputs) -> DataFrame:
    return ops.outcome_counts(ops.webhook_outcomes(t["deliveries"]))


@query(
    "new_deliveries",
    """
select idempotency_key, provider, event_type, attempt from {deliveries} d
where attempt = 2 and not exists (select 1 from {deliveries} f
  where f.idempotency_key = d.idempotency_key and f.attempt = 1 and f.process_ok)""",
)
def new_deliveries(t: Inputs) -> DataFrame:
    """Second attempts against the ledger the first ones left."""
    rows = t["deliveries"]
    status = F.when(F.col("process_ok"), vocab.PROCESSED).otherwise(vocab.FAILED)
    ledger = rows.where("attempt = 1").select(
        "idempotency_key", status.alias("processing_status")
    )
    again = rows.where("attempt = 2")
    return lookups.new_deliveries(again, ledger).select(
        "idempotency_key", "provider", "event_type", "attempt"
    )


@query(
    "notification_to_object",
    """
select e.event_id, e.object_id, c.email, c.lastmodifieddate
from {raw_envelopes} e join {raw_contacts} c on c.id = e.object_id
where e.event_type like 'contact.%'""",
)
def notification_to_object(t: Inputs) -> DataFrame:
    notes = t["raw_envelopes"].where(F.col("event_type").startswith(vocab.CONTACT_PREFIX))
    landed = inputs.contact_payloads(t["raw_contacts"])
    latest = lookups.latest_object(landed, CONTACTS.watermark(), ["updatedAt"])
    joined = lookups.notification_to_object(notes.select("event_id", "object_id"), latest)
    p = F.col("properties")
    return joined.select(
        "event_id",
        "object_id",
        p["email"].alias("email"),
        p["lastmodifieddate"].alias("lastmodifieddate"),
    )


@query(
    "latest_object",
    """
select id, event_id, status, changed_at from (select *, row_number() over (partition by id
  order by changed_at desc, event_id desc, attempt desc) as rn from {payment_changes}) where rn = 1""",
)
def latest_object(t: Inputs) -> DataFrame:
    latest = lookups.latest_object(
        t["payment_changes"], F.col("changed_at"), ["event_id", "attempt"]
    )
    return latest.select("id", "event_id", "status", "changed_at")


@query(
    "unconfigured_provider",
    """
select provider, entity_type, error_code, concat('Webhook received for ', provider, '/',
  entity_type, ' but that provider is not configured (missing credentials); event for "', context,
  '" was acknowledged but not persisted') as message, received_at as occurred_at
from (select *, 'PROVIDER_NOT_CONFIGURED' as error_code,
    case when provider = 'google_calendar' then 'event' else 'deal' end as entity_type,
    case when provider = 'google_calendar' then concat(channel_id, ':', resource_id)
      else object_id end as context
  from {raw_envelopes} where provider = 'google_calendar' or event_type like 'deal.%')""",
)
def unconfigured_provider(t: Inputs) -> DataFrame:
    """Deliveries for deals and calendars where only contacts and payments are set up."""
    parsed = ops.parse_envelopes(inputs.envelopes(t["raw_envelopes"]))
    log = lookups.unconfigured(parsed, Registry([CONTACTS, PAYMENTS]))
    return log.drop("job_id", "context")


