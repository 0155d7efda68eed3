"""Predicates over whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from revsync import vocab
from revsync.functions import outcomes, times


def date_range(
    start: datetime | None = None, end: datetime | None = None, now: datetime | None = None
) -> tuple[datetime, datetime]:
    """A checked half-open range: the end is now and the start 30 days earlier unless given."""
    end = end or now or datetime.now(timezone.utc).replace(tzinfo=None)
    start = start or end - timedelta(days=vocab.DEFAULT_RANGE_DAYS)
    if not (isinstance(start, datetime) and isinstance(end, datetime)):
        raise ValueError("a date range needs two times")
    if start >= end:
        raise ValueError(f"range start {start} must lie before its end {end}")
    return start, end


def in_range(c: Column, start: datetime, end: datetime) -> Column:
    start, end = date_range(start, end)
    return (c >= times.at(start)) & (c < times.at(end))


def range_filter(df: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    return df.where(in_range(F.col(column), start, end))


def allow_list(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is listed; an empty list lets nothing through."""
    return df.where(F.col(column).isin(list(allowed)) if allowed else F.lit(False))


def watermark_filter(df: DataFrame, modified: Column, watermark: Column) -> DataFrame:
    """Rows modified at the watermark or later."""
    return df.where(modified >= watermark)


def provider_entity_filter(
    df: DataFrame, provider: str | None = None, entity_type: str | None = None
) -> DataFrame:
    if provider is not None:
        df = df.where(F.col("provider") == provider)
    if entity_type is not None:
        df = df.where(F.col("entity_type") == entity_type)
    return df


def known_vocabulary(df: DataFrame) -> DataFrame:
    """Rows whose provider, and entity type if there is one, are known words."""
    df = df.where(outcomes.is_provider(F.col("provider")))
    if "entity_type" in df.columns:
        df = df.where(outcomes.is_entity_type(F.col("entity_type")))
    return df


def event_entity(event_type: Column) -> Column:
    """The entity an event type is about; null for events that change no data."""
    return (
        F.when(event_type.startswith(vocab.PAYMENT_INTENT_PREFIX), vocab.PAYMENT)
        .when(event_type.startswith(vocab.CONTACT_PREFIX), vocab.CONTACT)
        .when(event_type.startswith(vocab.DEAL_PREFIX), vocab.DEAL)
    )


def within_replay_window(received_at: Column, sent_at_ms: Column) -> Column:
    """Not older than five minutes. One from the future passes; one without a time does not."""
    sent = sent_at_ms.try_cast("double")
    finite = sent.isNotNull() & ~F.isnan(sent) & (F.abs(sent) < float("inf"))
    age = F.unix_millis(received_at.cast("timestamp")) - sent
    return finite & (age <= vocab.REPLAY_WINDOW_MS)


def is_handshake(resource_state: Column) -> Column:
    return F.coalesce(resource_state == vocab.HANDSHAKE_STATE, F.lit(False))


def channel_token_ok(channel_token: Column, configured: str | None) -> Column:
    if not configured:
        return F.lit(True)
    return F.coalesce(channel_token == configured, F.lit(False))
