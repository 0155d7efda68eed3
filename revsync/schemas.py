"""Schemas of landed payloads and of the tables this package writes."""

from __future__ import annotations

from pyspark.sql import types as T

from revsync import vocab

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A schema from names and types; works before there is a session."""
    return T.StructType(
        [T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()]
    )


# ---- landed payloads -------------------------------------------------------


def _crm_object(properties: list[str]) -> T.StructType:
    """A CRM object with the properties asked for. Naming them, where a map would take any,
    lets a scan read only those that a query uses."""
    named = struct(**{p: "string" for p in properties})
    return struct(id="string", properties=named, createdAt="string", updatedAt="string")


CONTACT_OBJECT = _crm_object(vocab.CONTACT_PROPERTIES)
DEAL_OBJECT = _crm_object(vocab.DEAL_PROPERTIES)

_EVENT_TIME = struct(dateTime="string", date="string", timeZone="string")
CALENDAR_EVENT = struct(
    id="string",
    summary="string",
    description="string",
    location="string",
    status="string",
    start=_EVENT_TIME,
    end=_EVENT_TIME,
    originalStartTime=_EVENT_TIME,
    organizer=struct(email="string"),
    attendees=T.ArrayType(struct(email="string", responseStatus="string")),
    recurringEventId="string",
    recurrence=T.ArrayType(T.StringType()),
    created="string",
    updated="string",
)

# `customer` is an id or an embedded object; the JSON reader hands an object over as text.
PAYMENT_INTENT = struct(
    id="string",
    created="bigint",
    status="string",
    amount="bigint",
    currency="string",
    customer="string",
    description="string",
)

# One row per webhook call; `object` is the payload's JSON where there is one.
ENVELOPE = struct(
    provider="string",
    event_type="string",
    event_id="string",
    event_created="bigint",
    subscription_id="string",
    object_id="string",
    channel_id="string",
    resource_id="string",
    message_number="string",
    resource_state="string",
    channel_token="string",
    received_at="string",
    sent_at="string",
    object="string",
)

# ---- canonical tables ------------------------------------------------------

_KEY = {"provider": "string", "source_id": "string"}
_COMMON = {
    "source_created_at": "timestamp_ntz",
    "source_updated_at": "timestamp_ntz",
    "synced_at": "timestamp_ntz",
    "raw": "string",
}

CONTACTS = struct(
    **_KEY,
    email="string",
    first_name="string",
    last_name="string",
    phone="string",
    company="string",
    lifecycle_stage="string",
    **_COMMON,
)
DEALS = struct(
    **_KEY,
    deal_name="string",
    stage="string",
    amount_minor="bigint",
    currency="string",
    pipeline="string",
    close_date="timestamp_ntz",
    primary_contact_source_id="string",
    **_COMMON,
)
EVENTS = struct(
    **_KEY,
    title="string",
    description="string",
    location="string",
    start_at="timestamp_ntz",
    end_at="timestamp_ntz",
    timezone="string",
    status="string",
    organizer_email="string",
    attendees=T.ArrayType(struct(email="string", response_status="string")),
    is_recurring="boolean",
    recurring_event_source_id="string",
    **_COMMON,
)
PAYMENTS = struct(
    **_KEY,
    amount_minor="bigint",
    currency="string",
    raw_status="string",
    canonical_status="string",
    customer_ref="string",
    occurred_at="timestamp_ntz",
    description="string",
    **_COMMON,
)

JOB_HISTORY = struct(
    id="string",
    provider="string",
    entity_type="string",
    mode="string",
    outcome="string",
    started_at="timestamp_ntz",
    finished_at="timestamp_ntz",
    records_fetched="bigint",
    records_upserted="bigint",
    records_failed="bigint",
    fell_back="boolean",
    error_summary="string",
)
FAILURE_LOGS = struct(
    provider="string",
    entity_type="string",
    job_id="string",
    error_code="string",
    message="string",
    context="string",
    occurred_at="timestamp_ntz",
)
WEBHOOK_EVENTS = struct(
    idempotency_key="string",
    provider="string",
    event_type="string",
    payload="string",
    received_at="timestamp_ntz",
    processing_status="string",
    processed_at="timestamp_ntz",
    error="string",
)
AUDIT = struct(
    entity_type="string",
    provider="string",
    source_id="string",
    operation="string",
    job_id="string",
    occurred_at="timestamp_ntz",
    snapshot="string",
)

LANDED_OBJECTS = struct(
    **_KEY, modified="timestamp_ntz", payload="string"
)
STATUS_MAPPINGS = struct(
    provider="string",
    raw_status="string",
    canonical_status="string",
    updated_at="timestamp_ntz",
)

# One row per commit of a table: the cursor sits in the row that makes its data visible.
COMMIT = struct(
    kind="string",
    batch_id="string",
    committed_at="timestamp_ntz",
    provider="string",
    entity_type="string",
    token="string",
    issued_at="timestamp_ntz",
    expires_at="timestamp_ntz",
    created="bigint",
    updated="bigint",
    unchanged="bigint",
    data="string",
    covers="int",
)
