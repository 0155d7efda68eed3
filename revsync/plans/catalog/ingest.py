"""Scans, dimensions and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revsync import schemas, vocab
from revsync.functions import outcomes, text
from revsync.operators import lookups, normalize
from revsync.plans import inputs
from revsync.plans.catalog import common
from revsync.plans.catalog.registry import query
from revsync.plans.inputs import Inputs
from revsync.sources import dims, landing
from revsync.sources.registry import CONTACTS

from datetime import datetime

_CRM_TIMES = """
  strftime(createdat, '%Y-%m-%dT%H:%M:%S.%gZ') as created_at,
  strftime(updatedat, '%Y-%m-%dT%H:%M:%S.%gZ') as updated_at"""
_ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def _scanned(payloads: DataFrame, schema) -> DataFrame:
    """Payloads as JSON text, read back the way landed text is."""
    lines = payloads.select(F.to_json(F.struct("*")).alias("value"))
    return landing.parse_landed(lines, "value", schema)


@query(
    "scan_contacts",
    "select id, email, firstname, lastname, phone, company, lifecyclestage, createdate, "
    f"lastmodifieddate, {_CRM_TIMES} from {{raw_contacts}}",
)
def scan_contacts(t: Inputs) -> DataFrame:
    landed = _scanned(inputs.contact_payloads(t["raw_contacts"]), schemas.CONTACT_OBJECT)
    return landing.named_properties(landed, vocab.CONTACT_PROPERTIES).withColumnsRenamed(
        {"createdAt": "created_at", "updatedAt": "updated_at"}
    )


@query(
    "scan_deals",
    "select id, dealname, dealstage, amount, pipeline, closedate, createdate, "
    "hs_lastmodifieddate from {raw_deals}",
)
def scan_deals(t: Inputs) -> DataFrame:
    landed = _scanned(inputs.deal_payloads(t["raw_deals"]), schemas.DEAL_OBJECT)
    return landing.named_properties(landed, vocab.DEAL_PROPERTIES).drop("createdAt", "updatedAt")


@query(
    "scan_calendar",
    f"""
select id, summary, status, strftime(start_datetime, {_ISO}) as start_date_time,
  cast(start_date as varchar) as start_date,
  case when start_datetime is not null or start_date is not null then timezone end
    as start_time_zone,
  strftime(end_datetime, {_ISO}) as end_date_time,
  strftime(original_start, {_ISO}) as original_start_date_time,
  recurring_event_id, strftime(updated, {_ISO}) as updated
from {{raw_calendar}}""",
)
def scan_calendar(t: Inputs) -> DataFrame:
    landed = _scanned(inputs.calendar_payloads(t["raw_calendar"]), schemas.CALENDAR_EVENT)
    return landed.select(
        "id",
        "summary",
        "status",
        F.col("start.dateTime").alias("start_date_time"),
        F.col("start.date").alias("start_date"),
        F.col("start.timeZone").alias("start_time_zone"),
        F.col("end.dateTime").alias("end_date_time"),
        F.col("originalStartTime.dateTime").alias("original_start_date_time"),
        F.col("recurringEventId").alias("recurring_event_id"),
        "updated",
    )


@query(
    "scan_payment_intents",
    "select id, cast(epoch(occurred_at) as bigint) as created, status, amount, currency, "
    "customer as customer_ref from {raw_payments}",
)
def scan_payment_intents(t: Inputs) -> DataFrame:
    """Every other customer comes as an object instead of an id."""
    payloads = inputs.payment_payloads(t["raw_payments"]).drop("provider")
    as_object = F.to_json(F.struct(F.col("customer").alias("id"), F.lit("customer").alias("object")))
    odd = F.col("amount") % 2 == 1
    lines = F.to_json(F.struct("*"))
    # The embedded object replaces the quoted id in the payload's text.
    embedded = F.replace(
        lines,
        F.concat(F.lit('"customer":"'), F.col("customer"), F.lit('"')),
        F.concat(F.lit('"customer":'), as_object),
    )
    landed = landing.parse_landed(
        payloads.select(F.when(odd, embedded).otherwise(lines).alias("value")),
        "value",
        schemas.PAYMENT_INTENT,
    )
    return landed.select(
        "id",
        "created",
        "status",
        "amount",
        "currency",
        normalize.customer_ref(F.col("customer")).alias("customer_ref"),
    )


@query(
    "scan_deliveries",
    f"""
select provider, event_type, event_id, subscription_id, object_id, channel_id, resource_id,
  message_number, resource_state, channel_token,
  strftime(received_at, {_ISO}) as received_at,
  cast(cast(epoch_ms(received_at) - lag_seconds * 1000 as bigint) as varchar) as sent_at
from {{raw_envelopes}}""",
)
def scan_deliveries(t: Inputs) -> DataFrame:
    landed = _scanned(inputs.envelopes(t["raw_envelopes"]), schemas.ENVELOPE)
    return landed.drop("object", "event_created", landing.CORRUPT)


@query(
    "status_map_dim",
    """
select m.provider, m.raw_status, m.canonical_status,
  cast(count(p.id) as bigint) as payments
from {status_map} m left join {raw_payments} p
  on p.provider = m.provider and lower(trim(p.status)) = m.raw_status
group by 1, 2, 3""",
)
def status_map_dim(t: Inputs) -> DataFrame:
    """The checked mapping, with how many payments use each of its rows."""
    mapping = dims.check_status_map(t["status_map"])
    used = (
        t["raw_payments"]
        .groupBy("provider", text.fold_status(F.col("status")).alias("raw_status"))
        .agg(F.count(F.lit(1)).alias("payments"))
    )
    return mapping.join(used, ["provider", "raw_status"], "left").select(
        *mapping.columns, F.coalesce("payments", F.lit(0)).alias("payments")
    )


@query(
    "provider_dim",
    """
select provider, case provider when 'hubspot' then 'crm' when 'stripe' then 'payments'
    when 'google_calendar' then 'calendar' end as source_system,
  case provider when 'hubspot' then 'HubSpot' when 'stripe' then 'Stripe'
    when 'google_calendar' then 'Google Calendar' end as display_name,
  cast(count(*) as bigint) as jobs
from {job_history} group by 1, 2, 3""",
)
def provider_dim(t: Inputs) -> DataFrame:
    jobs = t["job_history"].groupBy("provider").agg(F.count(F.lit(1)).alias("jobs"))
    return jobs.join(dims.provider_dim(t.spark), "provider").select(
        "provider",
        outcomes.source_system(F.col("provider")).alias("source_system"),
        "display_name",
        "jobs",
    )


_CONTACT_COLUMNS = """provider, source_id, email, first_name, last_name, phone, company,
  lifecycle_stage, source_created_at, source_updated_at"""


@query(
    "refetch_by_id",
    f"""
select {_CONTACT_COLUMNS} from {{contacts_all}}
where source_id in (select object_id from {{raw_envelopes}} where event_type like 'contact.%')""",
)
def refetch_by_id(t: Inputs) -> DataFrame:
    notes = t["raw_envelopes"].where(F.col("event_type").startswith(vocab.CONTACT_PREFIX))
    landed = inputs.contact_payloads(t["raw_contacts"])
    latest = lookups.refetch_by_id(notes, landed, CONTACTS.watermark(), ["updatedAt"])
    return normalize.normalize_contacts(latest).drop("raw", "normalize_ok", "normalize_error")


@query(
    "normalize_contacts",
    f"""
select {_CONTACT_COLUMNS}, raw
from {{contacts_all}} join (select id as source_id, cast(json_object('email', email,
  'firstname', firstname, 'lastname', lastname, 'phone', phone, 'company', company,
  'lifecyclestage', lifecyclestage, 'createdate', createdate,
  'lastmodifieddate', lastmodifieddate, 'id', id) as varchar) as raw from {{raw_contacts}})
using (source_id)""",
)
def normalize_contacts(t: Inputs) -> DataFrame:
    return common.contacts(t).drop("normalize_ok", "normalize_error")


@query(
    "normalize_deals",
    "select provider, source_id, deal_name, stage, amount_minor, currency, pipeline, close_date, "
    "primary_contact_source_id, source_created_at, source_updated_at from {deals_all} "
    "where normalize_error is null",
)
def normalize_deals(t: Inputs) -> DataFrame:
    return common.deals(t).where("normalize_ok").drop("raw", "normalize_ok", "normalize_error")


@query(
    "normalize_calendar",
    "select provider, source_id, title, start_at, end_at, timezone, status, is_recurring, "
    "recurring_event_source_id, source_updated_at from {calendar_all}",
)
def normalize_calendar(t: Inputs) -> DataFrame:
    return common.calendar(t).select(
        "provider", "source_id", "title", "start_at", "end_at", "timezone", "status",
        "is_recurring", "recurring_event_source_id", "source_updated_at",
    )


@query(
    "normalize_payments",
    "select provider, source_id, amount_minor, currency, raw_status, canonical_status, "
    "customer_ref, occurred_at, occurred_at as source_created_at, "
    "occurred_at as source_updated_at from {canonical_payments}",
)
def normalize_payments(t: Inputs) -> DataFrame:
    return common.payments(t).drop("raw", "description")


@query(
    "normalize_payment_event",
    """
select id as source_id, amount as amount_minor, upper(currency) as currency,
  status as raw_status, coalesce(canonical_status, 'unknown') as canonical_status,
  changed_at as occurred_at, changed_at as source_updated_at
from {payment_changes} c left join {status_map} m
  on m.provider = 'stripe' and m.raw_status = c.status""",
)
def normalize_payment_event(t: Inputs) -> DataFrame:
    envelopes = inputs.payment_change_envelopes(t["payment_changes"])
    return normalize.normalize_payment_event(envelopes, t["status_map"]).select(
        "source_id", "amount_minor", "currency", "raw_status", "canonical_status",
        "occurred_at", "source_updated_at",
    )


@query(
    "tag_kind_route",
    """
select 'contact' as kind, provider, source_id from {contacts_all}
union all select 'deal', provider, source_id from {deals_all}
union all select 'event', provider, source_id from {calendar_all}
union all select 'payment', provider, source_id from {canonical_payments}""",
)
def tag_kind_route(t: Inputs) -> DataFrame:
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "provider", "source_id")

    records = (
        tagged(common.contacts(t), vocab.CONTACT)
        .unionByName(tagged(common.deals(t), vocab.DEAL))
        .unionByName(tagged(common.calendar(t), vocab.EVENT))
        .unionByName(tagged(common.payments(t), vocab.PAYMENT))
    )
    routed = list(normalize.route_kinds(records).values())
    out = routed[0]
    for df in routed[1:]:
        out = out.unionByName(df)
    return out


@query(
    "stamp_synced_at",
    "select provider, source_id, timestamp '2026-03-01 12:00:00' as synced_at from {contacts_all}",
)
def stamp_synced_at(t: Inputs) -> DataFrame:
    stamped = normalize.stamp_synced_at(common.contacts(t), datetime(2026, 3, 1, 12))
    return stamped.select("provider", "source_id", "synced_at")
