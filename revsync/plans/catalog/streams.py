"""Streams over the given tables, run until they have read everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revsync import session, vocab
from revsync.plans import inputs, objects
from revsync.plans.catalog import common  # noqa: F401  (defines check views)
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.incremental import run_incremental
from revsync.plans.inputs import Inputs
from revsync.plans.warehouse import Warehouse
from revsync.sources.registry import CALENDAR, CONTACTS, DEALS, PAYMENTS, Registry, SourceSpec
from revsync.streaming.incremental import stream_incremental, utc_now
from revsync.streaming.webhooks import WebhookProcessor


def _warehouse(t: Inputs) -> Warehouse:
    return Warehouse(t.spark, session.new_scratch(t.spark, "warehouse"), t["status_map"])


@query(
    "stream_incremental",
    """
select provider, source_id, email, first_name, last_name, company, lifecycle_stage,
  source_created_at, source_updated_at
from {contacts_all} where issue_text = ''""",
)
def stream_contacts(t: Inputs) -> DataFrame:
    w = _warehouse(t)
    landed = inputs.contact_payloads(
        t.project("raw_contacts", {"customer": t.stream("customer")})
    )
    checkpoint = session.new_scratch(t.spark, "checkpoint")
    stream_incremental(w, CONTACTS, landed, checkpoint).awaitTermination()
    return w.tables[vocab.CONTACT].read().drop("phone", "synced_at", "raw")


def _payment_stream(t: Inputs) -> Warehouse:
    w = _warehouse(t)
    changes = t.project("payment_changes", {"events": t.stream("events", "event_id")})
    processor = WebhookProcessor(w, Registry([PAYMENTS]))
    query_ = processor.start(
        inputs.payment_change_envelopes(changes), session.new_scratch(t.spark, "checkpoint")
    )
    query_.awaitTermination()
    return w


@query(
    "stream_webhook_dedupe",
    """
select concat('stripe:', event_id) as idempotency_key, 'stripe' as provider, event_type,
  case when bool_or(currency = 'usd') then 'processed' else 'failed' end as processing_status
from {payment_changes} group by 1, 2, 3""",
)
def stream_webhook_dedupe(t: Inputs) -> DataFrame:
    """The ledger after a feed with repeated and failing deliveries."""
    return (
        _payment_stream(t)
        .webhook_events.read()
        .select("idempotency_key", "provider", "event_type", "processing_status")
    )


CHECK_VIEWS["ran_changes"] = """
select * from (select *, row_number() over (partition by event_id order by received_at) as rn
  from {payment_changes} where currency = 'usd') where rn = 1"""


@query(
    "stream_payment_transitions",
    """
select c.id as source_id, c.amount as amount_minor, upper(c.currency) as currency,
  c.status as raw_status, coalesce(m.canonical_status, 'unknown') as canonical_status,
  c.changed_at as source_updated_at
from (select *, row_number() over (partition by id
    order by received_at desc, attempt desc, event_type desc, event_id desc) as k
  from {ran_changes}) c
left join {status_map} m on m.provider = 'stripe' and m.raw_status = c.status
where k = 1""",
)
def stream_payment_transitions(t: Inputs) -> DataFrame:
    """Payments after their status changes: of several the last to arrive stands."""
    return _payment_stream(t).tables[vocab.PAYMENT].read().select(
        "source_id", "amount_minor", "currency", "raw_status", "canonical_status",
        "source_updated_at",
    )


@query(
    "stream_object_notifications",
    """
select 'contact' as entity_type, source_id, source_updated_at from {contacts_all}
where issue_text = '' and source_id in (select object_id from {raw_envelopes}
  where event_type like 'contact.%' and lag_seconds <= 300)
union all
select 'deal', source_id, source_updated_at from {deals_all}
where issue_text = '' and normalize_error is null and source_id in (
  select object_id from {raw_envelopes} where event_type like 'deal.%' and lag_seconds <= 300)
union all
select 'event', source_id, source_updated_at from {calendar_all}
where issue_text = '' and exists (select 1 from {raw_envelopes}
  where provider = 'google_calendar' and resource_state <> 'sync' and channel_token = 'secret')""",
)
def stream_object_notifications(t: Inputs) -> DataFrame:
    """Contacts and deals that notifications brought in, and events that pokes had loaded."""
    w = _warehouse(t)
    landed = {
        CONTACTS: inputs.contact_payloads(t.dealt("raw_contacts", "customer", "c_custkey")),
        DEALS: inputs.deal_payloads(t.dealt("raw_deals", "orders", "o_orderkey")),
    }
    for spec, payloads in landed.items():
        objects.keep(w, spec, payloads, "landed", utc_now())

    def load_calendar(spec: SourceSpec, batch_id: str) -> str | None:
        payloads = inputs.calendar_payloads(t.dealt("raw_calendar", "events", "event_id"))
        return run_incremental(w, spec, payloads, utc_now(), batch_id).error

    feed = t.project("raw_envelopes", {"events": t.stream("events", "event_id")})
    processor = WebhookProcessor(
        w, Registry([CONTACTS, DEALS, CALENDAR]), on_poke=load_calendar, channel_token="secret"
    )
    query_ = processor.start(inputs.envelopes(feed), session.new_scratch(t.spark, "checkpoint"))
    query_.awaitTermination()
    loaded = None
    for entity in (vocab.CONTACT, vocab.DEAL, vocab.EVENT):
        rows = w.tables[entity].read().select(
            F.lit(entity).alias("entity_type"), "source_id", "source_updated_at"
        )
        loaded = rows if loaded is None else loaded.unionByName(rows)
    return loaded
