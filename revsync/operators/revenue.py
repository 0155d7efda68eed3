"""Collected revenue. The only module that knows which statuses count.

A status counts because it is listed, never because it is not excluded, so a word
nobody mapped can only ever show up as a warning.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from revsync import vocab
from revsync.functions import money, times
from revsync.operators import filters

REVENUE_COLLECTED_STATUSES = ["collected"]


def counts_as_revenue(status: Column) -> Column:
    return status.isin(REVENUE_COLLECTED_STATUSES)


def _check_granularity(granularity: str) -> None:
    if granularity not in vocab.GRANULARITIES:
        raise ValueError(f"granularity must be one of {vocab.GRANULARITIES}, not {granularity!r}")


def revenue(
    payments: DataFrame,
    start: datetime,
    end: datetime,
    granularity: str = "total",
    statuses: list[str] | None = None,
) -> DataFrame:
    """Sum and count per bucket and currency over [start, end).

    Partial sums per task go through the shuffle, so a currency or a month holding
    most rows costs no more than any other. Amounts are whole numbers and a sum too
    large for one fails the job (ANSI arithmetic) instead of wrapping.
    """
    _check_granularity(granularity)
    statuses = REVENUE_COLLECTED_STATUSES if statuses is None else statuses
    kept = filters.allow_list(
        filters.range_filter(payments, "occurred_at", start, end), "canonical_status", statuses
    )
    grouped = kept.groupBy(
        times.bucket_start(F.col("occurred_at"), granularity, start).alias("bucket_start"),
        "currency",
    ).agg(
        F.sum("amount_minor").alias("amount_minor"), F.count(F.lit(1)).alias("payment_count")
    )
    return grouped.select(
        "bucket_start",
        times.bucket_end(F.col("bucket_start"), granularity, end).alias("bucket_end"),
        "currency",
        "amount_minor",
        "payment_count",
    )


def revenue_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.asc_nulls_first("bucket_start"), F.asc("currency"))


def unknown_statuses(payments: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Payments left out because nobody mapped their status, by the provider's own word."""
    return (
        filters.range_filter(payments, "occurred_at", start, end)
        .where(F.col("canonical_status") == vocab.UNKNOWN)
        .groupBy("provider", "raw_status")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "provider", "raw_status")
    )


BUCKET, WARNING = "bucket", "warning"


def report_rows(
    payments: DataFrame, start: datetime, end: datetime, granularity: str = "total"
) -> DataFrame:
    """Buckets and warnings of a range from one scan and one sum: `kind` says which a row is.

    A payment that counts adds to its bucket and currency, one nobody mapped to its
    provider's word; no row adds to both. A bucket then takes its currencies as an array, a
    handful, in `totals_by_currency`; a warning has `provider`, `raw_status` and `count`.
    """
    _check_granularity(granularity)
    counts, unknown = counts_as_revenue(F.col("canonical_status")), F.col("canonical_status") == vocab.UNKNOWN
    rows = filters.range_filter(payments, "occurred_at", start, end).where(counts | unknown)
    summed = rows.groupBy(
        F.when(counts, BUCKET).otherwise(WARNING).alias("kind"),
        F.when(counts, times.bucket_start(F.col("occurred_at"), granularity, start)).alias("bucket_start"),
        F.when(counts, F.col("currency")).alias("currency"),
        F.when(unknown, F.col("provider")).alias("provider"),
        F.when(unknown, F.col("raw_status")).alias("raw_status"),
    ).agg(
        F.sum(F.when(counts, F.col("amount_minor"))).alias("amount_minor"),
        F.count(F.lit(1)).alias("payment_count"),
    )
    is_bucket = F.col("kind") == BUCKET
    entry = F.when(is_bucket, F.struct("currency", "amount_minor", "payment_count"))
    nested = summed.groupBy("kind", "bucket_start", "provider", "raw_status").agg(
        F.array_sort(F.collect_list(entry)).alias("totals"), F.sum("payment_count").alias("n")
    )
    return nested.select(
        "kind",
        "bucket_start",
        F.when(is_bucket, times.bucket_end(F.col("bucket_start"), granularity, end)).alias("bucket_end"),
        F.when(is_bucket, F.col("totals")).alias("totals_by_currency"),
        "provider",
        "raw_status",
        F.when(~is_bucket, F.col("n")).alias("count"),
    )


class RevenueReport(NamedTuple):
    buckets: DataFrame
    warnings: DataFrame


def revenue_report(
    payments: DataFrame, start: datetime, end: datetime, granularity: str = "total"
) -> RevenueReport:
    """The parts of `report_rows`, each in its order. Who wants both reads that once."""
    rows = report_rows(payments, start, end, granularity)
    return RevenueReport(
        rows.where(F.col("kind") == BUCKET)
        .select("bucket_start", "bucket_end", "totals_by_currency")
        .orderBy("bucket_start"),
        rows.where(F.col("kind") == WARNING)
        .select("provider", "raw_status", "count")
        .orderBy(F.desc("count"), "provider", "raw_status"),
    )


def sum_by_currency(df: DataFrame, *keys: str) -> DataFrame:
    """Add money up, never across currencies."""
    return df.groupBy(*keys, "currency").agg(
        money.add_money(F.col("amount_minor")).alias("amount_minor")
    )
