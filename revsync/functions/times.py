"""Time rules. Every time is a zone-less UTC timestamp, in whole milliseconds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from revsync import vocab
from revsync.functions.text import non_empty

EPOCH = datetime(1970, 1, 1)


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def at(moment: datetime) -> Column:
    """A fixed moment; one without a zone is UTC, whatever zone this machine keeps."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return ntz(F.lit(moment.isoformat(sep=" ")))


def iso_ts(text: Column) -> Column:
    """ISO text to UTC; null for null, empty or unreadable text."""
    return ntz(F.date_trunc("millisecond", text.try_cast("timestamp")))


def iso_ts_or(text: Column, fallback: Column) -> Column:
    """`text` if it says anything, else `fallback`."""
    return iso_ts(F.coalesce(non_empty(text), fallback))


def bad_iso(text: Column) -> Column:
    """True for text that is there but is no time."""
    return F.coalesce((text != "") & text.try_cast("timestamp").isNull(), F.lit(False))


def event_time_text(c: Column) -> Column:
    """What a calendar time says: its dateTime, else its all-day date."""
    return F.coalesce(non_empty(c["dateTime"]), c["date"])


def event_time(c: Column) -> Column:
    """A calendar time; an all-day date is UTC midnight, whatever the zone."""
    return iso_ts(event_time_text(c))


def unix_ts(seconds: Column) -> Column:
    return ntz(F.timestamp_seconds(seconds))


def unix_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def to_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def bucket_start(ts: Column, granularity: str, range_start: datetime) -> Column:
    """Start of the UTC day, Monday week or month; the range start for a total."""
    if granularity == "total":
        return at(range_start)
    return ntz(F.date_trunc(granularity, ts))


def bucket_end(start: Column, granularity: str, range_end: datetime) -> Column:
    """Where a bucket ends; never clipped to the range."""
    if granularity == "total":
        return at(range_end)
    if granularity == "month":
        return ntz(F.add_months(start, 1))
    return start + F.expr({"day": "interval 1 day", "week": "interval 7 days"}[granularity])


# ---- cursors ---------------------------------------------------------------


def cursor_expired(expires_at: Column, now: Column) -> Column:
    return expires_at.isNotNull() & (now >= expires_at)


def cursor_stale(
    issued_at: Column,
    expires_at: Column,
    now: Column,
    max_age: timedelta = timedelta(hours=vocab.CURSOR_MAX_AGE_HOURS),
) -> Column:
    """Expired, or issued longer ago than the allowed age."""
    age_limit_ms = int(max_age.total_seconds() * 1000)
    return cursor_expired(expires_at, now) | (millis_between(issued_at, now) > age_limit_ms)


def sync_mode(token: Column, stale: Column) -> Column:
    return F.when(token.isNotNull() & ~stale, vocab.INCREMENTAL).otherwise(vocab.FULL)
