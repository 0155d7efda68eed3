"""Scalar rules, each over a whole table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revsync.functions import money, outcomes, text, times
from revsync.operators import deliveries, health, normalize, upsert
from revsync.plans import inputs
from revsync.plans.catalog import common
from revsync.plans.catalog.registry import query
from revsync.plans.inputs import Inputs

NOW = datetime(2024, 1, 31)
_NOW = "timestamp '2024-01-31 00:00:00'"
_STALE = f"""(coalesce(expires_at <= {_NOW}, false)
  or epoch_ms({_NOW}) - epoch_ms(issued_at) > 24 * 3600 * 1000)"""


@query("amount_to_minor", "select id, amount, minor as amount_minor from {deals_minor}")
def amount_to_minor(t: Inputs) -> DataFrame:
    given = text.non_empty(F.col("amount"))
    return t["raw_deals"].select(
        "id", "amount", money.amount_to_minor(given).alias("amount_minor")
    )


@query(
    "money",
    """
select id, amount as amount_minor, upper(trim(currency)) as currency,
  case when amount is null then 'Money.amountMinor must be an integer, got null'
    when amount < 0 then concat('Money.amountMinor must be >= 0, got ', cast(amount as varchar))
    when not regexp_matches(upper(trim(currency)), '^[A-Z][A-Z][A-Z]$')
      then concat('Money.currency must be an ISO-4217 code, got "', currency, '"')
    end as error
from {bad_payments}""",
)
def money_rule(t: Inputs) -> DataFrame:
    return t["bad_payments"].select(
        "id",
        F.col("amount").alias("amount_minor"),
        money.normalize_currency(F.col("currency")).alias("currency"),
        money.money_error(F.col("amount"), F.col("currency")).alias("error"),
    )


@query(
    "to_major",
    "select source_id, currency, cast(amount_minor as double) / 100 as amount_major "
    "from {canonical_payments}",
)
def to_major(t: Inputs) -> DataFrame:
    return common.payments(t).select(
        "source_id", "currency", money.to_major(F.col("amount_minor")).alias("amount_major")
    )


@query(
    "iso_ts_fallback",
    "select source_id as id, source_created_at, source_updated_at from {contacts_all}",
)
def iso_ts_fallback(t: Inputs) -> DataFrame:
    p = F.col("properties")
    return inputs.contact_payloads(t["raw_contacts"]).select(
        "id",
        times.iso_ts_or(p["createdate"], F.col("createdAt")).alias("source_created_at"),
        times.iso_ts_or(p["lastmodifieddate"], F.col("updatedAt")).alias("source_updated_at"),
    )


@query(
    "event_dt",
    "select id, coalesce(start_datetime, cast(start_date as timestamp)) as start_ts, "
    "end_datetime as end_ts, original_start as original_ts from {raw_calendar}",
)
def event_dt(t: Inputs) -> DataFrame:
    return inputs.calendar_payloads(t["raw_calendar"]).select(
        "id",
        times.event_time(F.col("start")).alias("start_ts"),
        times.event_time(F.col("end")).alias("end_ts"),
        times.event_time(F.col("originalStartTime")).alias("original_ts"),
    )


@query("unix_ts", "select id, occurred_at from {raw_payments}")
def unix_ts(t: Inputs) -> DataFrame:
    landed = inputs.payment_payloads(t["raw_payments"])
    return landed.select("id", times.unix_ts(F.col("created")).alias("occurred_at"))


@query("fold_status", "select id, lower(trim(status)) as folded_status from {raw_payments}")
def fold_status(t: Inputs) -> DataFrame:
    return t["raw_payments"].select(
        "id", text.fold_status(F.col("status")).alias("folded_status")
    )


@query(
    "attendees_norm",
    """
select id, cast(case when list_kind = 'one' then 1 else 0 end as int) as attendees,
  case when list_kind = 'one' then coalesce(email, '') end as first_email,
  case when list_kind = 'one' then response_status end as first_response
from {raw_invites}""",
)
def attendees_norm(t: Inputs) -> DataFrame:
    kind = F.col("list_kind")
    one = F.array(F.struct("email", F.col("response_status").alias("responseStatus")))
    none = F.array().cast("array<struct<email:string,responseStatus:string>>")
    listed = F.when(kind == "one", one).when(kind == "empty", none)
    normal = t["raw_invites"].select(
        "id", normalize.normalize_attendees(listed).alias("attendees")
    )
    first = F.get("attendees", F.lit(0))
    return normal.select(
        "id",
        F.size("attendees").alias("attendees"),
        first["email"].alias("first_email"),
        first["response_status"].alias("first_response"),
    )


@query(
    "bucket_end",
    """
select source_id, cast(date_trunc('day', occurred_at) as timestamp) + interval '1' day as day_end,
  cast(date_trunc('week', occurred_at) as timestamp) + interval '7' day as week_end,
  cast(date_trunc('month', occurred_at) as timestamp) + interval '1' month as month_end
from {bench_payments}""",
)
def bucket_end(t: Inputs) -> DataFrame:
    at = F.col("occurred_at")
    return common.payments(t, "raw_payments_bench").select(
        "source_id",
        *[
            times.bucket_end(times.bucket_start(at, g, NOW), g, NOW).alias(f"{g}_end")
            for g in ("day", "week", "month")
        ],
    )


@query(
    "idempotency_key",
    """
select event_id, case provider
  when 'hubspot' then concat('hubspot:', subscription_id, ':', event_id)
  when 'stripe' then concat('stripe:', event_id)
  else concat('google_calendar:', channel_id, ':', resource_id, ':',
    coalesce(message_number, 'undefined')) end as idempotency_key
from {raw_envelopes}""",
)
def idempotency_key(t: Inputs) -> DataFrame:
    parsed = deliveries.parse_envelopes(inputs.envelopes(t["raw_envelopes"]))
    return parsed.select("event_id", "idempotency_key")


@query(
    "cursor_expired",
    f"select provider, entity_type, coalesce(expires_at <= {_NOW}, false) as expired from {{cursors}}",
)
def cursor_expired(t: Inputs) -> DataFrame:
    expired = times.cursor_expired(F.col("expires_at"), times.at(NOW))
    return t["cursors"].select("provider", "entity_type", expired.alias("expired"))


def _stale():
    return times.cursor_stale(F.col("issued_at"), F.col("expires_at"), times.at(NOW))


@query("cursor_stale", f"select provider, entity_type, {_STALE} as stale from {{cursors}}")
def cursor_stale(t: Inputs) -> DataFrame:
    return t["cursors"].select("provider", "entity_type", _stale().alias("stale"))


@query(
    "sync_mode",
    f"select provider, entity_type, case when {_STALE} then 'full' else 'incremental' end as mode "
    "from {cursors}",
)
def sync_mode(t: Inputs) -> DataFrame:
    mode = times.sync_mode(F.col("token"), _stale())
    return t["cursors"].select("provider", "entity_type", mode.alias("mode"))


@query(
    "classify_outcome",
    """
select b.provider, b.source_id, b.arrival_seq,
  case when t.source_id is null then 'created'
    when t.source_updated_at = b.source_updated_at then 'unchanged' else 'updated' end as outcome
from {upsert_batch} b left join {upsert_target} t using (provider, source_id)""",
)
def classify_outcome(t: Inputs) -> DataFrame:
    """Every row of the batch by itself, copies included."""
    existing = t["upsert_target"].select(
        *upsert.KEY, F.col("source_updated_at").alias("had"), F.lit(True).alias("found")
    )
    joined = t["upsert_batch"].join(existing, upsert.KEY, "left")
    found = F.coalesce("found", F.lit(False))
    outcome = outcomes.classify_outcome(found, F.col("had"), F.col("source_updated_at"))
    return joined.select(*upsert.KEY, "arrival_seq", outcome.alias("outcome"))


@query(
    "classify_http",
    """
select http_status, error_code, code_ok.retryable, code_ok.requires_full_resync,
  code_ok.fatal_for_run, cast(count(*) as bigint) as calls
from (select http_status, case when http_status is null then 'PROVIDER_TIMEOUT'
    when http_status in (401, 403) then 'AUTHENTICATION_EXPIRED'
    when http_status = 410 then 'INVALID_CURSOR' when http_status = 429 then 'RATE_LIMITED'
    when http_status >= 500 then 'PROVIDER_UNAVAILABLE'
    when http_status >= 400 then 'MALFORMED_RESPONSE' else 'ok' end as error_code from {fetch_log})
join (select * from (values ('PROVIDER_TIMEOUT', true, false, false),
  ('AUTHENTICATION_EXPIRED', false, false, true), ('INVALID_CURSOR', false, true, false),
  ('RATE_LIMITED', true, false, false), ('PROVIDER_UNAVAILABLE', true, false, false),
  ('MALFORMED_RESPONSE', false, false, false), ('ok', false, false, false))
  as f(error_code, retryable, requires_full_resync, fatal_for_run)) code_ok using (error_code)
group by 1, 2, 3, 4, 5""",
)
def classify_http(t: Inputs) -> DataFrame:
    rows = health.classified_fetches(t["fetch_log"])
    return rows.groupBy(
        "http_status",
        F.coalesce("error_code", F.lit("ok")).alias("error_code"),
        "retryable",
        "requires_full_resync",
        "fatal_for_run",
    ).agg(F.count(F.lit(1)).alias("calls"))


@query(
    "retry_after_ms",
    "select event_id, cast(try_cast(retry_after as double) * 1000 as bigint) as retry_after_ms "
    "from {retry_headers}",
)
def retry_after_ms(t: Inputs) -> DataFrame:
    ms = outcomes.retry_after_ms(F.col("retry_after"))
    return t["retry_headers"].select("event_id", ms.alias("retry_after_ms"))


@query(
    "raw_json",
    """
select id, cast(json_object('dealname', dealname, 'dealstage', dealstage, 'amount', amount,
  'pipeline', pipeline, 'closedate', closedate, 'createdate', createdate,
  'hs_lastmodifieddate', hs_lastmodifieddate, 'id', id) as varchar) as raw
from {raw_deals}""",
)
def raw_json(t: Inputs) -> DataFrame:
    return common.deals(t).select(F.col("source_id").alias("id"), "raw")


@query(
    "duration",
    "select id, cast(epoch_ms(finished_at) - epoch_ms(started_at) as bigint) as duration_ms "
    "from {job_history}",
)
def duration(t: Inputs) -> DataFrame:
    ms = times.millis_between(F.col("started_at"), F.col("finished_at"))
    return t["job_history"].select("id", ms.alias("duration_ms"))
