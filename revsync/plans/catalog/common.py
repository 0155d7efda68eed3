"""Canonical frames that several queries start from, and the same as check views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revsync.operators import filters, normalize, validate
from revsync.plans import inputs
from revsync.plans.catalog.registry import CHECK_VIEWS
from revsync.plans.inputs import Inputs


def contacts(t: Inputs) -> DataFrame:
    return normalize.normalize_contacts(inputs.contact_payloads(t["raw_contacts"]))


def deals(t: Inputs) -> DataFrame:
    return normalize.normalize_deals(inputs.deal_payloads(t["raw_deals"]))


def calendar(t: Inputs) -> DataFrame:
    return normalize.normalize_calendar(inputs.calendar_payloads(t["raw_calendar"]))


#: Where a projection of payments takes their times from. A bound of whole seconds means the
#: same on the column as it is stored, which a scan can skip by.
_STORED_TIME = {"raw_payments": ("events", "ts"), "raw_payments_bench": ("lineitem", "l_shipdate")}


def payments_between(t: Inputs, start: datetime, end: datetime, source: str = "raw_payments") -> DataFrame:
    """Canonical payments of a range, and of the stored table only that range."""
    table, column = _STORED_TIME[source]
    raw = t.project(source, {table: filters.range_filter(t[table], column, start, end)})
    return _valid(_canonical(t, raw))


def all_payments(t: Inputs, source: str = "raw_payments") -> DataFrame:
    return _canonical(t, t[source])


def _canonical(t: Inputs, raw: DataFrame) -> DataFrame:
    provider = F.col("provider") if "provider" in raw.columns else "stripe"
    return normalize.normalize_payments(inputs.payment_payloads(raw), t["status_map"], provider)


def payments(t: Inputs, source: str = "raw_payments") -> DataFrame:
    """Canonical payments: the valid ones."""
    return _valid(all_payments(t, source))


def _valid(rows: DataFrame) -> DataFrame:
    return validate.split_valid_rejects(rows, validate.payment_rules())[0]


CHECK_VIEWS.update(
    {
        "canonical_payments": """
select p.provider, p.id as source_id, p.amount as amount_minor,
  upper(trim(p.currency)) as currency, p.status as raw_status,
  coalesce(m.canonical_status, 'unknown') as canonical_status, p.customer as customer_ref,
  p.occurred_at
from {raw_payments} p left join {status_map} m
  on m.provider = p.provider and m.raw_status = lower(trim(p.status))""",
        "bench_payments": """
select p.provider, p.id as source_id, p.amount as amount_minor,
  upper(trim(p.currency)) as currency, p.status as raw_status,
  coalesce(m.canonical_status, 'unknown') as canonical_status, p.customer as customer_ref,
  p.occurred_at
from {raw_payments_bench} p left join {status_map} m
  on m.provider = p.provider and m.raw_status = lower(trim(p.status))""",
        "contacts_all": """
select 'hubspot' as provider, id as source_id, email, firstname as first_name,
  lastname as last_name, phone, company, lifecyclestage as lifecycle_stage,
  case when createdate <> '' then cast(left(createdate, 23) as timestamp) else createdat end
    as source_created_at,
  case when lastmodifieddate <> '' then cast(left(lastmodifieddate, 23) as timestamp)
    else updatedat end as source_updated_at,
  concat_ws('; ',
    case when coalesce(id, '') = '' then 'sourceId: sourceId is required' end,
    case when email <> '' and not regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')
      then 'email: email is not a valid address' end) as issue_text,
  cast(null as varchar) as normalize_error
from {raw_contacts}""",
        "deals_minor": """
select *, case when amount <> '' then cast(floor(try_cast(regexp_extract(amount,
  '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1) as double) * 100 + 0.5)
  as bigint) end as minor
from {raw_deals}""",
        "deals_all": """
select 'hubspot' as provider, id as source_id, coalesce(dealname, '(untitled deal)') as deal_name,
  coalesce(dealstage, 'unknown') as stage, minor as amount_minor,
  case when amount <> '' then 'USD' end as currency, pipeline,
  try_cast(left(closedate, 23) as timestamp) as close_date,
  cast(null as varchar) as primary_contact_source_id,
  cast(left(createdate, 23) as timestamp) as source_created_at,
  cast(left(hs_lastmodifieddate, 23) as timestamp) as source_updated_at,
  concat_ws('; ', case when coalesce(id, '') = '' then 'sourceId: sourceId is required' end)
    as issue_text,
  case when amount <> '' and minor is null then 'Money.amountMinor must be an integer, got NaN'
    when minor < 0 then concat('Money.amountMinor must be >= 0, got ', cast(minor as varchar))
    end as normalize_error
from {deals_minor}""",
        "calendar_times": """
select *, coalesce(start_datetime, cast(start_date as timestamp), original_start) as start_ts,
  coalesce(end_datetime, original_start) as end_ts
from {raw_calendar}""",
        "calendar_norm": """
select 'google_calendar' as provider, id as source_id, coalesce(summary, '(no title)') as title,
  coalesce(start_ts, timestamp '1970-01-01 00:00:00') as start_at,
  coalesce(end_ts, start_ts, timestamp '1970-01-01 00:00:00') as end_at,
  case when start_datetime is not null or start_date is not null then timezone end as timezone,
  coalesce(status, 'confirmed') as status,
  coalesce(recurring_event_id, '') <> '' as is_recurring,
  recurring_event_id as recurring_event_source_id, updated as source_updated_at
from {calendar_times}""",
        "calendar_all": """
select *, concat_ws('; ',
    case when source_id = '' then 'sourceId: sourceId is required' end,
    case when status not in ('confirmed', 'tentative', 'cancelled')
      then concat('status: unrecognized event status "', status, '"') end,
    case when start_at = timestamp '1970-01-01 00:00:00'
      and end_at = timestamp '1970-01-01 00:00:00'
      then 'start: event has no usable start/end/originalStartTime' end,
    case when end_at < start_at then 'end: end must not be before start' end) as issue_text,
  cast(null as varchar) as normalize_error
from {calendar_norm}""",
        "bad_payments_all": """
select 'stripe' as provider, id as source_id, amount as amount_minor,
  concat_ws('; ', case when coalesce(id, '') = '' then 'sourceId: sourceId is required' end,
    case when amount < 0 then 'amount: amount must be non-negative' end) as issue_text,
  case when amount is null then 'Money.amountMinor must be an integer, got null'
    when amount < 0 then concat('Money.amountMinor must be >= 0, got ', cast(amount as varchar))
    when not regexp_matches(upper(trim(currency)), '^[A-Z][A-Z][A-Z]$')
      then concat('Money.currency must be an ISO-4217 code, got "', currency, '"')
    end as normalize_error
from {bad_payments}""",
    }
)
