"""Validation, rejects, CHECK rules and predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from revsync import schemas, session, vocab
from revsync.functions import outcomes
from revsync.operators import deliveries, filters, validate
from revsync.plans import inputs
from revsync.plans.catalog import common
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.inputs import Inputs
from revsync.plans.store import Log
from revsync.sources import dims, landing, registry

RANGE = (datetime(2024, 1, 3), datetime(2024, 1, 25))
IN_RANGE = (
    "occurred_at >= timestamp '2024-01-03 00:00:00' and "
    "occurred_at < timestamp '2024-01-25 00:00:00'"
)
LOGGED_AT = datetime(2026, 3, 1, 12)

_VERDICT = """
select provider, source_id, normalize_error is null and issue_text = '' as is_valid,
  case when normalize_error is not null then normalize_error
    when issue_text <> '' then concat('Validation failed: ', issue_text) end as reject_message
from {%s}"""


def _verdict(df: DataFrame, rules) -> DataFrame:
    return validate.check(df, rules).select("provider", "source_id", "is_valid", "reject_message")


@query("validate_contacts", _VERDICT % "contacts_all")
def validate_contacts(t: Inputs) -> DataFrame:
    return _verdict(common.contacts(t), validate.contact_rules())


@query("validate_deals", _VERDICT % "deals_all")
def validate_deals(t: Inputs) -> DataFrame:
    return _verdict(common.deals(t), validate.deal_rules())


@query("validate_calendar", _VERDICT % "calendar_all")
def validate_calendar(t: Inputs) -> DataFrame:
    return _verdict(common.calendar(t), validate.event_rules())


@query("validate_payments", _VERDICT % "bad_payments_all")
def validate_payments(t: Inputs) -> DataFrame:
    return _verdict(common.all_payments(t, "bad_payments"), validate.payment_rules())


@query(
    "split_valid_rejects",
    """
select case when normalize_error is null and issue_text = '' then 'valid' else 'reject' end as part,
  cast(count(*) as bigint) as records, cast(sum(amount_minor) as bigint) as amount_minor
from {deals_all} group by 1""",
)
def split_valid_rejects(t: Inputs) -> DataFrame:
    """Both parts' sums from one scan."""
    judged = validate.check(common.deals(t), validate.deal_rules())
    part = F.when(F.col("is_valid"), "valid").otherwise("reject").alias("part")
    return judged.groupBy(part).agg(
        F.count(F.lit(1)).alias("records"), F.sum("amount_minor").alias("amount_minor")
    )


def _rejects(t: Inputs, entity: str) -> DataFrame:
    df, spec = {
        vocab.CONTACT: (common.contacts, registry.CONTACTS),
        vocab.DEAL: (common.deals, registry.DEALS),
        vocab.EVENT: (common.calendar, registry.CALENDAR),
        vocab.PAYMENT: (lambda t: common.all_payments(t, "bad_payments"), registry.PAYMENTS),
    }[entity]
    rejects = validate.split_valid_rejects(df(t), spec.rules())[1]
    return validate.failure_rows(rejects, entity, "job_1", LOGGED_AT)


def _rejects_check(view: str, entity: str) -> str:
    return f"""
select provider, '{entity}' as entity_type, 'job_1' as job_id,
  'MALFORMED_RESPONSE' as error_code,
  coalesce(normalize_error, concat('Validation failed: ', issue_text)) as message,
  timestamp '2026-03-01 12:00:00' as occurred_at
from {{{view}}} where normalize_error is not null or issue_text <> ''"""


@query("sink_failures", _rejects_check("deals_all", "deal"))
def sink_failures(t: Inputs) -> DataFrame:
    """Rejects appended to a failure log and read back."""
    log = Log(t.spark, session.new_scratch(t.spark, "failure-logs"), schemas.FAILURE_LOGS)
    log.append(_rejects(t, vocab.DEAL))
    return log.read().drop("context")


@query(
    "failures_union",
    " union all ".join(
        _rejects_check(v, e)
        for v, e in [
            ("contacts_all", "contact"),
            ("deals_all", "deal"),
            ("calendar_all", "event"),
            ("bad_payments_all", "payment"),
        ]
    ),
)
def failures_union(t: Inputs) -> DataFrame:
    return validate.union_failures(*[_rejects(t, e) for e in vocab.ENTITY_TYPES]).drop("context")


CHECK_VIEWS["job_outcomes"] = """
select *, case when records_failed = 0 then 'success' when records_upserted > 0
  then 'partial_failure' else 'failed' end as outcome
from {job_history}"""


@query(
    "check_constraints",
    """
select 'canonical_deals' as table_name, source_id as id, 'deal_amount_non_negative' as violations
from {deals_all} where amount_minor < 0
union all
select 'canonical_events', source_id, concat_ws(',',
  case when status not in ('confirmed', 'tentative', 'cancelled') then 'event_status_valid' end,
  case when end_at < start_at then 'event_end_after_start' end)
from {calendar_all} where status not in ('confirmed', 'tentative', 'cancelled') or end_at < start_at
union all
select 'canonical_payments', id, concat_ws(',',
  case when amount < 0 then 'payment_amount_non_negative' end,
  case when not regexp_matches(upper(trim(currency)), '^[A-Z][A-Z][A-Z]$')
    then 'payment_currency_iso4217_format' end)
from {bad_payments}
where amount < 0 or not regexp_matches(upper(trim(currency)), '^[A-Z][A-Z][A-Z]$')
union all
select 'job_history', id, 'job_history_outcome_valid' from {provider_rows}
where status not in ('success', 'partial_failure', 'failed')
union all
select 'payment_status_mappings', id, 'payment_status_mapping_canonical_valid' from {provider_rows}
where status not in ('collected', 'pending', 'failed', 'refunded', 'cancelled', 'unknown')
union all
select 'providers', id, 'provider_source_system_valid' from {provider_rows} where status <> 'pending'
union all
select 'sync_metadata', id, concat_ws(',',
  case when status <> 'settled' then 'sync_metadata_status_valid' end,
  case when entity_type <> 'event' then 'sync_metadata_mode_valid' end)
from {provider_rows} where status <> 'settled' or entity_type <> 'event'
union all
select 'webhook_events', id, 'webhook_event_status_valid' from {provider_rows} where status <> 'collected'
union all
select 'canonical_record_audit', id, 'canonical_record_audit_operation_valid'
from {provider_rows} where status <> 'settled'""",
)
def check_constraints(t: Inputs) -> DataFrame:
    """Rows each table's rules keep out, and the rules they break."""
    rows = t["provider_rows"]

    def instead(column: str, word: str, good: str) -> Column:
        return F.when(F.col(column) == word, good).otherwise(F.col(column))

    candidates = {
        "canonical_deals": common.deals(t).withColumnRenamed("source_id", "id"),
        "canonical_events": common.calendar(t).withColumnRenamed("source_id", "id"),
        "canonical_payments": common.all_payments(t, "bad_payments").withColumnRenamed(
            "source_id", "id"
        ),
        "job_history": rows.select(
            "id", F.lit(vocab.FULL).alias("mode"), F.col("status").alias("outcome")
        ),
        "payment_status_mappings": rows.select("id", F.col("status").alias("canonical_status")),
        "providers": rows.select("id", instead("status", "pending", "crm").alias("source_system")),
        "sync_metadata": rows.select(
            "id",
            instead("status", "settled", vocab.SUCCESS).alias("last_sync_status"),
            instead("entity_type", vocab.EVENT, vocab.FULL).alias("last_sync_mode"),
        ),
        "webhook_events": rows.select(
            "id", instead("status", "collected", vocab.PROCESSED).alias("processing_status")
        ),
        "canonical_record_audit": rows.select(
            "id", instead("status", "settled", vocab.CREATED).alias("operation")
        ),
    }
    out = None
    for table, df in candidates.items():
        kept_out = validate.quarantine(df, table)[1].select(
            F.lit(table).alias("table_name"), "id", "violations"
        )
        out = kept_out if out is None else out.unionByName(kept_out)
    return out


@query(
    "fk_provider",
    "select id, provider from {provider_rows} "
    "where provider in ('hubspot', 'google_calendar', 'stripe')",
)
def fk_provider(t: Inputs) -> DataFrame:
    """Rows that may be written: their provider exists."""
    kept = validate.enforce_provider_fk(t["provider_rows"], dims.provider_dim(t.spark))
    return kept.select("id", "provider")


@query(
    "fk_anti",
    "select id, provider from {provider_rows} "
    "where provider not in ('hubspot', 'google_calendar', 'stripe')",
)
def fk_anti(t: Inputs) -> DataFrame:
    unknown = validate.unknown_providers(t["provider_rows"], dims.provider_dim(t.spark))
    return unknown.select("id", "provider")


@query(
    "enum_filter",
    """
select id, provider, entity_type, status from {provider_rows}
where provider in ('hubspot', 'google_calendar', 'stripe')
  and entity_type in ('contact', 'deal', 'event', 'payment')
  and status in ('collected', 'pending', 'failed', 'refunded', 'cancelled', 'unknown')""",
)
def enum_filter(t: Inputs) -> DataFrame:
    known = filters.known_vocabulary(t["provider_rows"])
    return known.where(outcomes.is_payment_status(F.col("status")))


@query(
    "range_filter",
    f"select provider, source_id, occurred_at from {{canonical_payments}} where {IN_RANGE}",
)
def range_filter(t: Inputs) -> DataFrame:
    kept = filters.range_filter(common.payments_between(t, *RANGE), "occurred_at", *RANGE)
    return kept.select("provider", "source_id", "occurred_at")


@query(
    "allow_list",
    "select provider, source_id, canonical_status from {canonical_payments} "
    "where canonical_status in ('collected', 'pending')",
)
def allow_list(t: Inputs) -> DataFrame:
    kept = filters.allow_list(common.payments(t), "canonical_status", ["collected", "pending"])
    return kept.select("provider", "source_id", "canonical_status")


#: Each source's cursor, and what it has landed as: payloads, and the day each landed on.
CURSORS = {
    vocab.CONTACT: datetime(2026, 1, 15),
    vocab.DEAL: datetime(1996, 3, 15),
    vocab.EVENT: datetime(2024, 1, 15),
    vocab.PAYMENT: datetime(2024, 1, 15),
}
CHECK_VIEWS["changed"] = """
select * from (
  select 'contact' as entity_type, id, cast(left(lastmodifieddate, 23) as timestamp) as modified,
    timestamp '2026-01-15 00:00:00' as since from {raw_contacts}
  union all
  select 'deal', id, cast(left(hs_lastmodifieddate, 23) as timestamp),
    timestamp '1996-03-15 00:00:00' from {raw_deals}
  union all
  select 'event', id, updated, timestamp '2024-01-15 00:00:00' from {raw_calendar}
  union all
  select 'payment', id, occurred_at, timestamp '2024-01-15 00:00:00' from {bad_payments})
where modified >= since"""


def landed_sources(t: Inputs) -> list[tuple[registry.SourceSpec, DataFrame]]:
    """All sources' payloads, landed by day as JSON and read again; deals land once a month."""

    def some_days_later(modified: Column) -> Column:
        lag = F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")
        return F.date_add(F.coalesce(modified.cast("date"), F.lit("2026-01-31").cast("date")), lag)

    sources = [
        (registry.CONTACTS, inputs.contact_payloads(t["raw_contacts"]), some_days_later),
        (registry.DEALS, inputs.deal_payloads(t["raw_deals"]), F.last_day),
        (registry.CALENDAR, inputs.calendar_payloads(t["raw_calendar"]), some_days_later),
        (registry.PAYMENTS, inputs.payment_payloads(t["bad_payments"]), some_days_later),
    ]
    read = []
    for spec, payloads, on in sources:
        path = session.new_scratch(t.spark, f"landing-{spec.entity_type}")
        landing.land(payloads, path, on(spec.watermark()))
        read.append((spec, landing.read_landed(t.spark, path, spec.payload)))
    return read


def _changed(t: Inputs) -> DataFrame:
    out = None
    for spec, landed in landed_sources(t):
        changed = spec.changed_since(landed, CURSORS[spec.entity_type]).select(
            F.lit(spec.entity_type).alias("entity_type"), "id", spec.watermark().alias("modified")
        )
        out = changed if out is None else out.unionByName(changed)
    return out


@query("watermark_filter", "select entity_type, id, modified from {changed}")
def watermark_filter(t: Inputs) -> DataFrame:
    """What changed since each source's cursor; files that landed before it are not opened."""
    return _changed(t)


@query(
    "incremental_order",
    "select entity_type, id, modified from {changed} order by entity_type, modified, id",
)
def incremental_order(t: Inputs) -> DataFrame:
    """What changed since the cursors, oldest change first."""
    return _changed(t).orderBy("entity_type", "modified", "id")


@query(
    "last_row_watermark",
    "select entity_type, max(modified) as watermark from {changed} group by 1",
)
def last_row_watermark(t: Inputs) -> DataFrame:
    """The last row of an ascending load holds the greatest time: a maximum, without the sort."""
    return _changed(t).groupBy("entity_type").agg(F.max("modified").alias("watermark"))


@query(
    "provider_entity_filter",
    "select id, provider, entity_type, started_at from {job_history} "
    "where provider = 'hubspot' and entity_type = 'deal'",
)
def provider_entity_filter(t: Inputs) -> DataFrame:
    kept = filters.provider_entity_filter(t["job_history"], vocab.HUBSPOT, vocab.DEAL)
    return kept.select("id", "provider", "entity_type", "started_at")


@query(
    "event_type_route",
    """
select idempotency_key, attempt, event_type,
  case when event_type like 'payment\\_intent.%' escape '\\' then 'payment'
    when event_type like 'contact.%' then 'contact'
    when event_type like 'deal.%' then 'deal' else 'acknowledged' end as routed_to
from {deliveries}""",
)
def event_type_route(t: Inputs) -> DataFrame:
    entity = filters.event_entity(F.col("event_type"))
    return t["deliveries"].select(
        "idempotency_key",
        "attempt",
        "event_type",
        F.coalesce(entity, F.lit("acknowledged")).alias("routed_to"),
    )


@query(
    "replay_window",
    """
select event_id, provider from {raw_envelopes}
where provider <> 'hubspot' or lag_seconds <= 300""",
)
def replay_window(t: Inputs) -> DataFrame:
    parsed = deliveries.parse_envelopes(inputs.envelopes(t["raw_envelopes"]))
    return deliveries.replay_window(parsed).select("event_id", "provider")


@query(
    "handshake_drop",
    """
select event_id, provider from {raw_envelopes}
where provider <> 'google_calendar' or (resource_state <> 'sync' and channel_token = 'secret')""",
)
def handshake_drop(t: Inputs) -> DataFrame:
    parsed = deliveries.parse_envelopes(inputs.envelopes(t["raw_envelopes"]))
    return deliveries.handshake_drop(parsed, "secret").select("event_id", "provider")


