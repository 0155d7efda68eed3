"""Classifications: upserts, runs, provider answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revsync import vocab


def classify_outcome(exists: Column, existing_updated: Column, incoming_updated: Column) -> Column:
    """What an upsert did to a row, judged by its source's own update time.

    A row that is there without an update time counts as updated, not created.
    """
    return (
        F.when(~exists, vocab.CREATED)
        .when(existing_updated == incoming_updated, vocab.UNCHANGED)
        .otherwise(vocab.UPDATED)
    )


def run_outcome(upserted: Column, failed: Column) -> Column:
    return (
        F.when(failed == 0, vocab.SUCCESS)
        .when(upserted > 0, vocab.PARTIAL_FAILURE)
        .otherwise(vocab.FAILED)
    )


def error_code(http_status: Column) -> Column:
    """The failure a provider's answer stands for; null where it is none."""
    return (
        F.when(http_status.isNull(), vocab.PROVIDER_TIMEOUT)
        .when(http_status.isin(401, 403), vocab.AUTHENTICATION_EXPIRED)
        .when(http_status == 410, vocab.INVALID_CURSOR)
        .when(http_status == 429, vocab.RATE_LIMITED)
        .when(http_status >= 500, vocab.PROVIDER_UNAVAILABLE)
        .when(http_status >= 400, vocab.MALFORMED_RESPONSE)
    )


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(vocab.RETRYABLE_CODES), F.lit(False))


def requires_full_resync(code: Column) -> Column:
    return F.coalesce(code.isin(vocab.FULL_RESYNC_CODES), F.lit(False))


def fatal_for_run(code: Column) -> Column:
    return F.coalesce(code.isin(vocab.FATAL_CODES), F.lit(False))


def retry_after_ms(header_seconds: Column) -> Column:
    """A Retry-After header in milliseconds; null where it is missing or no number."""
    return (header_seconds.try_cast("double") * 1000).cast("bigint")


def source_system(provider: Column) -> Column:
    """The kind of system behind a provider; null for an unknown provider."""
    c = None
    for name, system in vocab.PROVIDER_SOURCE_SYSTEM.items():
        c = F.when(provider == name, system) if c is None else c.when(provider == name, system)
    return c


def is_provider(c: Column) -> Column:
    return c.isin(vocab.PROVIDERS)


def is_entity_type(c: Column) -> Column:
    return c.isin(vocab.ENTITY_TYPES)


def is_payment_status(c: Column) -> Column:
    return c.isin(vocab.PAYMENT_STATUSES)
