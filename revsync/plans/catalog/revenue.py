"""Status mapping and collected revenue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revsync.operators import revenue as ops, status
from revsync.plans.catalog import common
from revsync.plans.catalog.quality import IN_RANGE, RANGE
from revsync.plans.catalog.registry import query
from revsync.plans.inputs import Inputs

# The second payments projection spans years; this range cuts into buckets at both ends.
LONG_RANGE = (datetime(1996, 3, 15), datetime(2000, 8, 10))
IN_LONG_RANGE = (
    "occurred_at >= timestamp '1996-03-15 00:00:00' and "
    "occurred_at < timestamp '2000-08-10 00:00:00'"
)


def _sql(view: str, in_range: str, start: str, end: str) -> str:
    return f"""
select {start} as bucket_start, {end} as bucket_end, currency,
  cast(sum(amount_minor) as bigint) as amount_minor, cast(count(*) as bigint) as payment_count
from {{{view}}} where {in_range} and canonical_status = 'collected' group by 1, 2, 3"""


def _trunc(unit: str) -> str:
    return f"cast(date_trunc('{unit}', occurred_at) as timestamp)"


def _bucket(unit: str) -> tuple[str, str]:
    width = {"day": "interval '1' day", "week": "interval '7' day", "month": "interval '1' month"}
    return _trunc(unit), f"{_trunc(unit)} + {width[unit]}"


@query(
    "map_status",
    "select provider, source_id, raw_status, canonical_status from {canonical_payments}",
)
def map_status(t: Inputs) -> DataFrame:
    rows = t["raw_payments"].select(
        "provider", F.col("id").alias("source_id"), F.col("status").alias("raw_status")
    )
    return status.map_status(rows, t["status_map"])


@query(
    "revenue_total",
    _sql(
        "canonical_payments",
        IN_RANGE,
        "timestamp '2024-01-03 00:00:00'",
        "timestamp '2024-01-25 00:00:00'",
    ),
)
def revenue_total(t: Inputs) -> DataFrame:
    return ops.revenue(common.payments_between(t, *RANGE), *RANGE)


@query("revenue_daily", _sql("canonical_payments", IN_RANGE, *_bucket("day")))
def revenue_daily(t: Inputs) -> DataFrame:
    return ops.revenue(common.payments_between(t, *RANGE), *RANGE, "day")


@query("revenue_weekly", _sql("canonical_payments", IN_RANGE, *_bucket("week")))
def revenue_weekly(t: Inputs) -> DataFrame:
    return ops.revenue(common.payments_between(t, *RANGE), *RANGE, "week")


@query("revenue_monthly", _sql("canonical_payments", IN_RANGE, *_bucket("month")))
def revenue_monthly(t: Inputs) -> DataFrame:
    return ops.revenue(common.payments_between(t, *RANGE), *RANGE, "month")


def _long(t: Inputs, granularity: str) -> DataFrame:
    return ops.revenue(common.payments_between(t, *LONG_RANGE, "raw_payments_bench"), *LONG_RANGE, granularity)


@query(
    "revenue_total_years",
    _sql(
        "bench_payments",
        IN_LONG_RANGE,
        "timestamp '1996-03-15 00:00:00'",
        "timestamp '2000-08-10 00:00:00'",
    ),
)
def revenue_total_years(t: Inputs) -> DataFrame:
    return _long(t, "total")


@query("revenue_daily_years", _sql("bench_payments", IN_LONG_RANGE, *_bucket("day")))
def revenue_daily_years(t: Inputs) -> DataFrame:
    return _long(t, "day")


@query("revenue_weekly_years", _sql("bench_payments", IN_LONG_RANGE, *_bucket("week")))
def revenue_weekly_years(t: Inputs) -> DataFrame:
    return _long(t, "week")


@query("revenue_monthly_years", _sql("bench_payments", IN_LONG_RANGE, *_bucket("month")))
def revenue_monthly_years(t: Inputs) -> DataFrame:
    return _long(t, "month")


@query(
    "revenue_order",
    _sql("canonical_payments", IN_RANGE, *_bucket("week"))
    + " order by bucket_start nulls first, currency",
)
def revenue_order(t: Inputs) -> DataFrame:
    return ops.revenue_order(ops.revenue(common.payments_between(t, *RANGE), *RANGE, "week"))


@query(
    "revenue_report_nested",
    f"""
select 'bucket' as kind, bucket_start, bucket_end, cast(to_json(list(struct_pack(currency := currency,
  amount_minor := amount_minor, payment_count := payment_count) order by currency)) as varchar)
  as totals_by_currency, null as provider, null as raw_status, cast(null as bigint) as count
from ({_sql("canonical_payments", IN_RANGE, *_bucket("week"))}) group by 1, 2, 3
union all
select 'warning', null, null, null, provider, raw_status, cast(count(*) as bigint)
from {{canonical_payments}} where {IN_RANGE} and canonical_status = 'unknown' group by 5, 6""",
)
def revenue_report_nested(t: Inputs) -> DataFrame:
    """Buckets with an array of totals, shown as JSON, and warnings, from one scan."""
    report = ops.report_rows(common.payments_between(t, *RANGE), *RANGE, "week")
    return report.withColumn("totals_by_currency", F.to_json("totals_by_currency"))


@query(
    "unknown_status_warnings",
    f"""
select provider, raw_status, cast(count(*) as bigint) as count from {{canonical_payments}}
where {IN_RANGE} and canonical_status = 'unknown' group by 1, 2""",
)
def unknown_status_warnings(t: Inputs) -> DataFrame:
    return ops.unknown_statuses(common.payments_between(t, *RANGE), *RANGE)


@query(
    "unknown_status_warnings_years",
    f"""
select provider, raw_status, cast(count(*) as bigint) as count from {{bench_payments}}
where {IN_LONG_RANGE} and canonical_status = 'unknown' group by 1, 2""",
)
def unknown_status_warnings_years(t: Inputs) -> DataFrame:
    return ops.unknown_statuses(common.payments_between(t, *LONG_RANGE, "raw_payments_bench"), *LONG_RANGE)


@query(
    "money_add",
    "select provider, currency, cast(sum(amount_minor) as bigint) as amount_minor "
    "from {canonical_payments} group by 1, 2",
)
def money_add(t: Inputs) -> DataFrame:
    return ops.sum_by_currency(common.payments(t), "provider")
