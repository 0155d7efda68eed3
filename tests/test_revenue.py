"""Hand-computed revenue totals and edge cases."""

import pytest
from helpers import at, payments, rows

from revsync.operators import filters, revenue

RANGE = (at("2026-01-01"), at("2026-03-01"))


@pytest.fixture(scope="module")
def golden(spark):
    data = [
        ("stripe", "succeeded", "collected", 5000, "USD", "2026-01-28T10:00"),
        ("stripe", "succeeded", "collected", 2500, "USD", "2026-01-28T14:00"),
        ("hubspot", "completed", "collected", 10000, "USD", "2026-01-30T09:00"),
        ("hubspot", "paid", "collected", 3000, "EUR", "2026-01-30T09:30"),
        ("stripe", "pending", "pending", 99999, "USD", "2026-01-29T00:00"),
        ("stripe", "failed", "failed", 88888, "USD", "2026-01-29T01:00"),
        ("stripe", "refunded", "refunded", 4000, "USD", "2026-02-02T00:00"),
        ("hubspot", "voided", "cancelled", 1500, "USD", "2026-02-02T01:00"),
        ("stripe", "captured", "collected", 7500, "USD", "2026-02-14T12:00"),
        ("hubspot", "chargeback_pending_review", "unknown", 123456, "USD", "2026-02-20T00:00"),
        ("hubspot", "chargeback_pending_review", "unknown", 654321, "USD", "2026-02-21T00:00"),
        ("stripe", "succeeded", "collected", 1000000, "USD", "2026-03-03T00:00"),
    ]
    return payments(spark, [(*r[:5], at(r[5])) for r in data])


def buckets(df):
    return rows(df, "bucket_start", "currency", "amount_minor", "payment_count")


def test_total(golden):
    assert rows(revenue.revenue(golden, *RANGE)) == [
        (*RANGE, "EUR", 3000, 1),
        (*RANGE, "USD", 25000, 4),
    ]


def test_month(golden):
    assert buckets(revenue.revenue(golden, *RANGE, "month")) == [
        (at("2026-01-01"), "EUR", 3000, 1),
        (at("2026-01-01"), "USD", 17500, 3),
        (at("2026-02-01"), "USD", 7500, 1),
    ]


def test_week_starts_on_monday(golden):
    df = revenue.revenue(golden, *RANGE, "week")
    assert buckets(df) == [
        (at("2026-01-26"), "EUR", 3000, 1),
        (at("2026-01-26"), "USD", 17500, 3),
        (at("2026-02-09"), "USD", 7500, 1),
    ]
    assert {r.bucket_end - r.bucket_start for r in df.collect()} == {
        at("2026-01-08") - at("2026-01-01")
    }


def test_day(golden):
    day = revenue.revenue(golden, *RANGE, "day").where("bucket_start = timestamp'2026-01-28'")
    assert rows(day) == [(at("2026-01-28"), at("2026-01-29"), "USD", 7500, 2)]


def test_month_ends_on_the_first_of_the_next(golden):
    df = revenue.revenue(golden, *RANGE, "month")
    assert {(r.bucket_start, r.bucket_end) for r in df.collect()} == {
        (at("2026-01-01"), at("2026-02-01")),
        (at("2026-02-01"), at("2026-03-01")),
    }


def test_warnings(golden):
    assert rows(revenue.unknown_statuses(golden, *RANGE)) == [
        ("hubspot", "chargeback_pending_review", 2)
    ]


def test_report_nests_currencies(golden):
    report = revenue.revenue_report(golden, *RANGE, "month")
    january = report.buckets.first()
    assert [tuple(x) for x in january.totals_by_currency] == [
        ("EUR", 3000, 1),
        ("USD", 17500, 3),
    ]
    assert report.warnings.count() == 1


def test_half_open_range(spark):
    df = payments(
        spark,
        [
            ("stripe", "s", "collected", 500, "USD", at("2025-12-31T23:59:59")),
            ("stripe", "s", "collected", 700, "USD", at("2026-01-15T00:00:00")),
            ("stripe", "s", "collected", 900, "USD", at("2026-02-01T00:00:00")),
        ],
    )
    got = revenue.revenue(df, at("2026-01-01"), at("2026-02-01")).collect()
    assert [(r.amount_minor, r.payment_count) for r in got] == [(700, 1)]


def test_no_rows_no_bucket(spark):
    empty = payments(spark, [])
    for g in ("total", "day", "week", "month"):
        assert revenue.revenue(empty, *RANGE, g).collect() == []


def test_empty_allow_list_counts_nothing(golden):
    assert revenue.revenue(golden, *RANGE, statuses=[]).collect() == []


def test_granularities_agree(spark):
    df = payments(spark, [("stripe", "s", "collected", 1234, "USD", at("2026-01-10T05:00"))])
    for g in ("total", "day", "week", "month"):
        assert [r.amount_minor for r in revenue.revenue(df, *RANGE, g).collect()] == [1234]


def test_first_bucket_may_start_before_the_range(spark):
    df = payments(spark, [("stripe", "s", "collected", 1, "USD", at("2026-01-02T05:00"))])
    got = revenue.revenue(df, at("2026-01-02"), at("2026-01-03"), "week").first()
    assert got.bucket_start == at("2025-12-29")


def test_too_large_a_sum_fails_instead_of_wrapping(spark):
    df = payments(
        spark, [("stripe", "s", "collected", 2**62, "USD", at("2026-01-02"))] * 3
    )
    with pytest.raises(Exception, match="(?i)overflow"):
        revenue.revenue(df, *RANGE).collect()


def test_one_currency_holds_most_rows(spark):
    """A hot currency in one bucket: the sum is whole and only partial sums are shuffled."""
    hot = spark.range(30000).selectExpr(
        "'stripe' provider", "'s' raw_status", "'collected' canonical_status",
        "id amount_minor", "if(id % 3 = 0, 'USD', concat('C', id % 50)) currency",
        "timestamp_ntz'2026-01-05 00:00:00' occurred_at",
    )
    df = revenue.revenue(hot, *RANGE, "day")
    usd = df.where("currency = 'USD'").first()
    assert (usd.amount_minor, usd.payment_count) == (sum(range(0, 30000, 3)), 10000)
    assert "partial_sum" in df._jdf.queryExecution().executedPlan().toString()


def test_bad_granularity_and_range(golden):
    with pytest.raises(ValueError):
        revenue.revenue(golden, *RANGE, "year")
    with pytest.raises(ValueError):
        revenue.revenue(golden, RANGE[1], RANGE[0])
    with pytest.raises(ValueError):
        revenue.revenue(golden, RANGE[0], RANGE[0])


def test_default_range_is_the_last_thirty_days():
    now = at("2026-03-31T12:00")
    assert filters.date_range(now=now) == (at("2026-03-01T12:00"), now)


def test_sums_never_mix_currencies(spark):
    df = payments(
        spark,
        [
            ("stripe", "s", "collected", 1000, "USD", at("2026-01-02")),
            ("stripe", "s", "collected", 850, "EUR", at("2026-01-02")),
        ],
    )
    assert rows(revenue.sum_by_currency(df)) == [("EUR", 850), ("USD", 1000)]
