"""The given tables in the shapes of landed data.

Each text below is one projection of the given tables, read by Spark and by the SQL
check alike; `{name}` stands for a table or for another projection. They contain bad
rows on purpose, so that validation has something to reject.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from revsync import session, vocab
from revsync.functions import times

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

#: Parts for each core that a table's rows are dealt into, so that what a task sorts stays small.
DEALS_A_CORE = 4

SOURCE_OF_USER = """
  case user_id % 3 when 0 then 'hubspot' when 1 then 'stripe' else 'google_calendar' end"""
ENTITY_OF_USER = """
  case user_id % 3 when 0 then (case when user_id % 2 = 0 then 'contact' else 'deal' end)
    when 1 then 'payment' else 'event' end"""

PROJECTIONS = {
    "status_map": """
select * from (values
 ('stripe','succeeded','collected'),('stripe','processing','pending'),
 ('stripe','requires_payment_method','pending'),('stripe','requires_action','pending'),
 ('stripe','requires_confirmation','pending'),('stripe','requires_capture','pending'),
 ('stripe','canceled','cancelled'),('hubspot','paid','collected'),
 ('hubspot','completed','collected')
) as m(provider, raw_status, canonical_status)""",
    "raw_payments": """
select case when user_id % 2 = 0 then 'stripe' else 'hubspot' end as provider,
  concat('pi_', cast(event_id as string)) as id,
  cast(floor(value * 100 + 0.5) as bigint) as amount,
  case user_id % 3 when 0 then 'usd' when 1 then ' eur ' else 'GBP' end as currency,
  case event_type when 'purchase' then ' Succeeded' when 'signup' then 'processing'
    when 'view' then 'PAID' when 'click' then 'canceled'
    else 'chargeback_pending_review' end as status,
  cast(user_id as string) as customer,
  date_trunc('second', ts) as occurred_at
from {events}""",
    "raw_payments_bench": """
select case when l_suppkey % 2 = 0 then 'stripe' else 'hubspot' end as provider,
  concat('pi_', cast(l_orderkey as string), '_', cast(l_linenumber as string)) as id,
  cast(floor(l_extendedprice * 100 + 0.5) as bigint) as amount,
  case l_suppkey % 3 when 0 then 'usd' when 1 then ' eur ' else 'GBP' end as currency,
  case l_returnflag when 'R' then 'canceled' when 'A' then 'Succeeded' else 'paid' end as status,
  cast(l_partkey as string) as customer,
  l_shipdate as occurred_at
from {lineitem}""",
    # Payments as one provider hands them over: some amounts and currencies are no money.
    "bad_payments": """
select concat('pi_', cast(event_id as string)) as id,
  case when event_id % 13 = 0 then null when event_id % 17 = 0 then cast(-5 as bigint)
    else cast(floor(value * 100 + 0.5) as bigint) end as amount,
  case when event_id % 11 = 0 then 'us' when event_id % 19 = 0 then '' else 'usd' end as currency,
  case event_type when 'purchase' then 'succeeded' when 'signup' then 'processing'
    else event_type end as status,
  cast(user_id as string) as customer, date_trunc('second', ts) as occurred_at
from {events}""",
    "raw_contacts": """
select cast(c_custkey as string) as id,
  case c_custkey % 10 when 0 then 'not-an-email' when 1 then '' when 2 then null
    else concat('user', cast(c_custkey as string), '@example.com') end as email,
  split_part(c_name, '#', 1) as firstname, split_part(c_name, '#', 2) as lastname,
  cast(null as string) as phone, concat('Company ', c_mktsegment) as company,
  lower(c_mktsegment) as lifecyclestage,
  case when c_custkey % 4 = 0 then '' else concat('2025-01-',
    lpad(cast(1 + c_custkey % 28 as string), 2, '0'), 'T00:00:00.000Z') end as createdate,
  case when c_custkey % 6 = 0 then null else concat('2026-01-',
    lpad(cast(1 + c_custkey % 28 as string), 2, '0'), 'T00:00:00.000Z') end as lastmodifieddate,
  cast('2024-12-01 00:00:00' as timestamp) as createdat,
  cast('2024-12-02 00:00:00' as timestamp) as updatedat
from {customer}""",
    "raw_deals": """
select case when o_orderkey % 97 = 0 then '' else cast(o_orderkey as string) end as id,
  case when o_orderkey % 11 = 0 then null else concat('Deal ', cast(o_orderkey as string)) end as dealname,
  case when o_orderkey % 13 = 0 then null when o_orderstatus = 'F' then 'closedwon'
    when o_orderstatus = 'O' then 'appointmentscheduled' else 'contractsent' end as dealstage,
  case o_orderkey % 7 when 0 then null when 1 then '' when 2 then '12.5abc'
    when 3 then 'n/a' when 4 then '-5'
    else cast(cast(o_totalprice as decimal(18,2)) as string) end as amount,
  o_orderpriority as pipeline,
  case when o_orderstatus = 'F' then concat(cast(cast(o_orderdate as date) as string), 'T00:00:00.000Z') end as closedate,
  concat(cast(cast(o_orderdate as date) as string), 'T00:00:00.000Z') as createdate,
  concat(cast(cast(o_orderdate as date) as string), 'T06:00:00.000Z') as hs_lastmodifieddate,
  cast(o_custkey as string) as contact_id
from {orders}""",
    "raw_calendar": """
select concat('evt_', cast(event_id as string)) as id,
  case when event_id % 9 = 0 then null else concat(event_type, ' meeting') end as summary,
  case event_type when 'error' then 'cancelled' when 'click' then 'tentative'
    when 'signup' then 'needsAction' when 'view' then null else 'confirmed' end as status,
  case when event_type <> 'error' and event_id % 4 <> 0 then date_trunc('second', ts) end as start_datetime,
  case when event_type <> 'error' and event_id % 4 = 0 then cast(ts as date) end as start_date,
  case when event_type <> 'error' and event_id % 8 <> 0
    then date_trunc('second', ts) + (case when event_id % 10 = 1 then interval '-1' hour else interval '30' minute end) end as end_datetime,
  case when event_type = 'error' and event_id % 2 = 0 then date_trunc('second', ts) end as original_start,
  case when event_id % 4 <> 0 then 'UTC' end as timezone,
  case when event_id % 5 = 0 then concat('series_', cast(user_id as string)) end as recurring_event_id,
  date_trunc('second', ts) as updated
from {events}""",
    # Who was asked to an event: nobody (no list), nobody (an empty list), or one person.
    "raw_invites": """
select concat('evt_', cast(event_id as string)) as id,
  case event_id % 5 when 0 then 'none' when 1 then 'empty' else 'one' end as list_kind,
  case when event_id % 3 = 0 then null else concat('user', cast(user_id as string), '@example.com') end as email,
  case when event_id % 2 = 0 then 'accepted' end as response_status
from {events}""",
    "deliveries": """
select provider, concat(provider, ':evt_', cast(event_id as string)) as idempotency_key,
  event_type, attempt, received_at, process_ok
from (
  select event_id,
    case when user_id % 2 = 0 then 'stripe' else 'hubspot' end as provider,
    case event_type when 'purchase' then 'payment_intent.succeeded' when 'signup' then 'payment_intent.processing'
      when 'view' then 'contact.propertyChange' when 'click' then 'deal.creation' else 'charge.updated' end as event_type,
    1 as attempt, date_trunc('second', ts) as received_at, (event_id % 15 <> 0) as process_ok
  from {events}
  union all
  select event_id, case when user_id % 2 = 0 then 'stripe' else 'hubspot' end,
    case event_type when 'purchase' then 'payment_intent.succeeded' when 'signup' then 'payment_intent.processing'
      when 'view' then 'contact.propertyChange' when 'click' then 'deal.creation' else 'charge.updated' end,
    2, date_trunc('second', ts) + interval '90' second, (event_id % 30 <> 0)
  from {events} where event_id % 5 = 0
) d""",
    # Webhook calls of all three providers; `lag_seconds` is how long one took to arrive.
    "raw_envelopes": f"""
select {SOURCE_OF_USER} as provider,
  case user_id % 3
    when 0 then case event_id % 4 when 0 then 'contact.propertyChange' when 1 then 'deal.creation'
      when 2 then 'contact.creation' else 'company.creation' end
    when 1 then case event_type when 'purchase' then 'payment_intent.succeeded'
      when 'signup' then 'payment_intent.processing' when 'view' then 'payment_intent.canceled'
      else 'charge.updated' end
    else case event_id % 6 when 0 then 'sync' else 'exists' end end as event_type,
  cast(event_id as string) as event_id,
  cast(user_id % 7 as string) as subscription_id,
  case when user_id % 3 = 0 then cast(event_id % 2000 as string) end as object_id,
  case when user_id % 3 = 2 then concat('channel_', cast(user_id % 5 as string)) end as channel_id,
  case when user_id % 3 = 2 then concat('resource_', cast(user_id as string)) end as resource_id,
  case when user_id % 3 = 2 and event_id % 10 <> 3 then cast(event_id as string) end as message_number,
  case when user_id % 3 = 2 then (case event_id % 6 when 0 then 'sync' else 'exists' end) end as resource_state,
  case when event_id % 12 = 5 then 'wrong' else 'secret' end as channel_token,
  date_trunc('second', ts) as received_at,
  case when event_id % 50 = 0 then null else event_id % 400 end as lag_seconds
from {{events}}""",
    # Status changes: three events in a row are about one payment; some come twice, and some
    # carry a currency that is none until they are sent again.
    "payment_changes": """
select concat('pe_', cast(event_id as string)) as event_id,
  concat('payment_intent.', event_type) as event_type,
  concat('pi_', cast(event_id - event_id % 3 as string)) as id,
  cast(floor(value * 100 + 0.5) as bigint) as amount,
  case event_type when 'purchase' then 'succeeded' when 'signup' then 'processing'
    when 'click' then 'canceled' else event_type end as status,
  cast(user_id as string) as customer, date_trunc('second', ts) as changed_at,
  date_trunc('millisecond', ts) as received_at, 1 as attempt,
  case when event_id % 15 = 0 then 'us' else 'usd' end as currency
from {events}
union all
select concat('pe_', cast(event_id as string)), concat('payment_intent.', event_type),
  concat('pi_', cast(event_id - event_id % 3 as string)),
  cast(floor(value * 100 + 0.5) as bigint),
  case event_type when 'purchase' then 'succeeded' when 'signup' then 'processing'
    when 'click' then 'canceled' else event_type end,
  cast(user_id as string), date_trunc('second', ts),
  date_trunc('millisecond', ts) + interval '90' second, 2,
  case when event_id % 30 = 0 then 'us' else 'usd' end
from {events} where event_id % 5 = 0""",
    "job_history": f"""
select concat('job_', cast(event_id as string)) as id,
  {SOURCE_OF_USER} as provider, {ENTITY_OF_USER} as entity_type,
  case when event_id % 7 = 0 then 'full' else 'incremental' end as mode,
  date_trunc('second', ts) as started_at,
  date_trunc('second', ts) + interval '45' second as finished_at,
  cast(event_id % 40 as int) as records_fetched,
  cast(case when event_id % 6 = 0 then 0 else (event_id % 40) - (event_id % 4) end as int) as records_upserted,
  cast(event_id % 4 as int) as records_failed,
  value as duration_seconds
from {{events}}""",
    "fetch_log": f"""
select concat('job_', cast(event_id - event_id % 3 as string)) as job_id,
  {SOURCE_OF_USER} as provider, {ENTITY_OF_USER} as entity_type,
  'fetch' as operation, cast(1 + event_id % 3 as int) as attempt,
  case event_id % 9 when 0 then 401 when 1 then 403 when 2 then 410 when 3 then 429
    when 4 then 500 when 5 then 503 when 6 then 404 when 7 then null else 200 end as http_status,
  date_trunc('second', ts) as occurred_at
from {{events}}""",
    # Retry-After headers of the same calls: seconds, nothing, or something unreadable.
    "retry_headers": """
select event_id, case event_id % 4 when 0 then cast(event_id % 120 as string) when 1 then ''
  when 2 then 'soon' else '1.5' end as retry_after
from {events}""",
    "cursors": f"""
select {SOURCE_OF_USER} as provider,
  concat('entity_', cast(user_id as string)) as entity_type,
  cast(max(event_id) as string) as token,
  date_trunc('second', max(ts)) as issued_at,
  case when user_id % 4 = 0 then date_trunc('second', max(ts)) + interval '1' hour end as expires_at
from {{events}} group by user_id""",
    # New cursors for some of the sources, and for some that had none.
    "issued_cursors": """
select provider, case when expires_at is null then entity_type
    else concat(entity_type, '_new') end as entity_type,
  concat(token, '_next') as token, issued_at + interval '15' minute as issued_at,
  cast(null as timestamp) as expires_at
from {cursors}""",
    "upsert_target": """
select provider, id as source_id, amount as amount_minor, occurred_at as source_updated_at
from {raw_payments} where cast(substring(id, 4) as bigint) % 3 <> 0""",
    "upsert_batch": """
select provider, id as source_id, amount as amount_minor, 1 as arrival_seq,
  case when cast(substring(id, 4) as bigint) % 4 = 0 then occurred_at + interval '1' hour
    else occurred_at end as source_updated_at
from {raw_payments} where cast(substring(id, 4) as bigint) % 2 = 0
union all
select provider, id, cast(0 as bigint), 0, occurred_at - interval '1' day
from {raw_payments} where cast(substring(id, 4) as bigint) % 10 = 0""",
    # Rows of providers, some of which nobody knows.
    "provider_rows": f"""
select concat('row_', cast(event_id as string)) as id,
  case when event_type = 'error' then concat('legacy_', cast(user_id % 4 as string))
    else {SOURCE_OF_USER} end as provider,
  case when event_type = 'view' then 'invoice' else {ENTITY_OF_USER} end as entity_type,
  case event_type when 'click' then 'settled' when 'signup' then 'pending' else 'collected' end as status
from {{events}}""",
}

NAME = re.compile(r"\{(\w+)\}")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(NAME.findall(sql)))


class Inputs:
    """The given tables under one folder, and their projections, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = session.prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self.project(name, {n: self[n] for n in names_in(PROJECTIONS[name])})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def project(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        """A projection of the tables given."""
        return as_ntz(self.spark.sql(PROJECTIONS[name], **tables))

    def stream(self, table: str, key: str | None = None) -> DataFrame:
        """A given table as a stream of its files, dealt out by `key` as `dealt` does."""
        rows = (
            self.spark.readStream.schema(self[table].schema)
            .option("pathGlobFilter", f"{table}.parquet")
            .parquet(self.sf_dir)
        )
        return rows.repartition(self._deals(), key) if key else rows

    def dealt(self, name: str, table: str, key: str) -> DataFrame:
        """A projection of a given table whose rows are dealt out to tasks by `key` first.

        One row group is read by one task, however many rows it has. Where rows are turned
        into payloads and checked, that should not be that task's work alone.
        """
        return self.project(name, {table: self[table].repartition(self._deals(), key)})

    def _deals(self) -> int:
        return DEALS_A_CORE * self.spark.sparkContext.defaultParallelism


def as_ntz(df: DataFrame) -> DataFrame:
    """All times zone-less, in UTC."""
    return df.select(
        *[
            times.ntz(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---- projections as payloads -----------------------------------------------


def contact_payloads(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id",
        F.struct(*vocab.CONTACT_PROPERTIES).alias("properties"),
        times.to_iso(F.col("createdat")).alias("createdAt"),
        times.to_iso(F.col("updatedat")).alias("updatedAt"),
    )


def deal_payloads(raw: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return raw.select(
        "id",
        F.struct(*vocab.DEAL_PROPERTIES).alias("properties"),
        none.alias("createdAt"),
        none.alias("updatedAt"),
    )


def _event_time(ts: str, date: str | None = None, zone: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    known = F.col(ts).isNotNull()
    if date:
        known = known | F.col(date).isNotNull()
    return F.when(
        known,
        F.struct(
            times.to_iso(F.col(ts)).alias("dateTime"),
            (F.col(date).cast("string") if date else none).alias("date"),
            (F.col(zone) if zone else none).alias("timeZone"),
        ),
    )


def calendar_payloads(raw: DataFrame) -> DataFrame:
    none = F.lit(None)
    return raw.select(
        "id",
        "summary",
        none.cast("string").alias("description"),
        none.cast("string").alias("location"),
        "status",
        _event_time("start_datetime", "start_date", "timezone").alias("start"),
        _event_time("end_datetime").alias("end"),
        _event_time("original_start").alias("originalStartTime"),
        none.cast("struct<email:string>").alias("organizer"),
        none.cast("array<struct<email:string,responseStatus:string>>").alias("attendees"),
        F.col("recurring_event_id").alias("recurringEventId"),
        none.cast("array<string>").alias("recurrence"),
        none.cast("string").alias("created"),
        times.to_iso(F.col("updated")).alias("updated"),
    )


def payment_payloads(raw: DataFrame) -> DataFrame:
    """Payment intents; the provider column stays where the projection has several."""
    keep = [c for c in ("provider",) if c in raw.columns]
    return raw.select(
        *keep,
        "id",
        times.unix_seconds(F.col("occurred_at")).alias("created"),
        "status",
        "amount",
        "currency",
        "customer",
        F.lit(None).cast("string").alias("description"),
    )


def envelopes(raw: DataFrame) -> DataFrame:
    """Webhook calls as they land; the payment ones carry no object here."""
    lag_ms = F.col("lag_seconds") * 1000
    received = F.unix_millis(F.col("received_at").cast("timestamp"))
    return raw.select(
        "provider", "event_type", "event_id",
        times.unix_seconds(F.col("received_at")).alias("event_created"),
        "subscription_id", "object_id", "channel_id", "resource_id", "message_number",
        "resource_state", "channel_token",
        times.to_iso(F.col("received_at")).alias("received_at"),
        (received - lag_ms).cast("string").alias("sent_at"),
        F.lit(None).cast("string").alias("object"),
    )


def payment_change_envelopes(changes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    changed = times.unix_seconds(F.col("changed_at"))
    payment = F.struct(
        "id", changed.alias("created"), "status", "amount", "currency", "customer"
    )
    return changes.select(
        F.lit(vocab.STRIPE).alias("provider"), "event_type", "event_id",
        changed.alias("event_created"),
        *[none.alias(c) for c in (
            "subscription_id", "object_id", "channel_id", "resource_id", "message_number",
            "resource_state", "channel_token")],
        times.to_iso(F.col("received_at")).alias("received_at"),
        none.alias("sent_at"),
        F.to_json(payment).alias("object"),
        "attempt",
    )
