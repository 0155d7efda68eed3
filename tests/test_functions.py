"""Scalar rules against plain Python on small fixtures."""

import math
import re
from datetime import timedelta

import pytest
from helpers import at, each, first, lit_ts, texts
from pyspark.sql import functions as F

from revsync import vocab
from revsync.functions import money, outcomes, text, times
from revsync.operators import filters

AMOUNTS = [
    "1500.50", "12.5abc", "n/a", "", None, "-5", "0", "0.005", "-0.005", "-0.004", "1e3", "1e3x",
    ".5", "5.", ".", "+7.25", "  42", "\t8", "1,234", "0x10", "1.005", "2.675", "1e400", "9e20",
    "--5", "1e", "1e+", "3.14.15", "٣",
]


def minor(s):
    m = re.match(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", s or "")
    if not m:
        return None
    scaled = float(m.group(1)) * 100
    return math.floor(scaled + 0.5) if abs(scaled) < 9.2e18 else None


def test_amount_to_minor(spark):
    got = each(texts(spark, AMOUNTS), money.amount_to_minor(F.col("v")))
    assert got == [minor(s) for s in AMOUNTS]


def test_money(spark):
    cases = [
        (100, "usd", True), (100, " Usd\n", True), (0, "USD", True), (-1, "USD", False),
        (None, "USD", False), (1, "us", False), (1, "usdx", False), (1, None, False),
        (1, "u$d", False), (1, " eur ", True),
    ]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], "i int, a bigint, c string")
    assert each(df, money.is_money(F.col("a"), F.col("c"))) == [ok for *_, ok in cases]
    errors = each(df, money.money_error(F.col("a"), F.col("c")))
    assert [e is None for e in errors] == [ok for *_, ok in cases]
    assert errors[3] == "Money.amountMinor must be >= 0, got -1"
    assert errors[4] == "Money.amountMinor must be an integer, got null"
    assert errors[5] == 'Money.currency must be an ISO-4217 code, got "us"'


def test_email_pattern(spark):
    values = ["a@b.co", "not-an-email", "a@b", "a b@c.d", "a@b.co\n", "a@@b.co", "a@b.c.d"]
    got = each(texts(spark, values), F.col("v").rlike(vocab.EMAIL_PATTERN))
    assert got == [True, False, False, False, False, False, True]


def test_trim_takes_every_white_space(spark):
    values = [" a ", "\ta\n", "  a b　", "a", "", "   ", None, "﻿é "]
    assert each(texts(spark, values), text.trim_ws(F.col("v"))) == [
        "a", "a", "a b", "a", "", "", None, "é",
    ]


def test_iso_times(spark):
    values = [
        "2025-01-01T00:00:00.000Z", "2025-01-01T05:00:00+02:00", "2025-01-01", "", None, "soon",
        "2025-01-01T00:00:00.123456Z",
    ]
    df = texts(spark, values)
    assert each(df, times.iso_ts(F.col("v"))) == [
        at("2025-01-01"), at("2025-01-01T03:00"), at("2025-01-01"), None, None, None,
        at("2025-01-01T00:00:00.123"),
    ]
    assert each(df, times.bad_iso(F.col("v"))) == [False] * 5 + [True, False]


def test_unix_and_buckets(spark):
    ts = lit_ts("2026-12-31 23:59:59.5")
    got = first(
        spark,
        times.unix_ts(F.lit(0)),
        *[times.bucket_start(ts, g, at("2026-01-01")) for g in ("total", "day", "week", "month")],
        times.bucket_end(lit_ts("2026-01-31 00:00:00"), "day", at("2027-01-01")),
        times.bucket_end(lit_ts("2026-12-01 00:00:00"), "month", at("2027-01-01")),
        times.bucket_end(ts, "total", at("2027-01-01")),
    )
    assert got == (
        at("1970-01-01"), at("2026-01-01"), at("2026-12-31"), at("2026-12-28"), at("2026-12-01"),
        at("2026-02-01"), at("2027-01-01"), at("2027-01-01"),
    )


def test_results_do_not_depend_on_this_machines_zone(spark, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        literal = times.at(at("2026-07-01T12:00"))
        assert first(spark, literal.cast("string"))[0] == "2026-07-01 12:00:00"
    finally:
        monkeypatch.undo()
        time.tzset()


NOW = at("2026-02-01T00:00")


@pytest.mark.parametrize(
    "issued, expires, expired, stale",
    [
        (NOW, None, False, False),
        (NOW - timedelta(hours=24), None, False, False),
        (NOW - timedelta(hours=24, milliseconds=1), None, False, True),
        (NOW, NOW, True, True),
        (NOW, NOW + timedelta(milliseconds=1), False, False),
    ],
)
def test_cursors(spark, issued, expires, expired, stale):
    e = times.at(expires) if expires else F.lit(None).cast("timestamp_ntz")
    s = times.cursor_stale(times.at(issued), e, times.at(NOW))
    mode = times.sync_mode(F.lit("t"), s)
    got = first(spark, times.cursor_expired(e, times.at(NOW)), s, mode)
    assert got == (expired, stale, "full" if stale else "incremental")


def test_classify_outcome(spark):
    t1, t2, none = lit_ts("2026-01-01 00:00:00"), lit_ts("2026-01-02 00:00:00"), lit_ts(None)
    yes, no = F.lit(True), F.lit(False)
    got = first(
        spark,
        outcomes.classify_outcome(no, none, t1),
        outcomes.classify_outcome(yes, t1, t1),
        outcomes.classify_outcome(yes, t1, t2),
        outcomes.classify_outcome(yes, t1, none),
        outcomes.classify_outcome(yes, none, t1),
    )
    assert got == ("created", "unchanged", "updated", "updated", "updated")


def test_http_classes(spark):
    want = {
        401: "AUTHENTICATION_EXPIRED", 403: "AUTHENTICATION_EXPIRED", 410: "INVALID_CURSOR",
        429: "RATE_LIMITED", 500: "PROVIDER_UNAVAILABLE", 503: "PROVIDER_UNAVAILABLE",
        404: "MALFORMED_RESPONSE", None: "PROVIDER_TIMEOUT", 200: None,
    }
    df = spark.createDataFrame([(i, s) for i, s in enumerate(want)], "i int, s int")
    code = outcomes.error_code(F.col("s"))
    assert each(df, code) == list(want.values())
    assert each(df, outcomes.retryable(code)) == [
        c in ("RATE_LIMITED", "PROVIDER_TIMEOUT", "PROVIDER_UNAVAILABLE") for c in want.values()
    ]
    assert each(df, outcomes.requires_full_resync(code))[2] is True
    assert each(df, outcomes.fatal_for_run(code))[:3] == [True, True, False]


def test_retry_after(spark):
    got = each(texts(spark, ["30", "1.5", "", None, "soon"]), outcomes.retry_after_ms(F.col("v")))
    assert got == [30000, 1500, None, None, None]


def test_replay_window(spark):
    received = lit_ts("1970-01-01 00:10:00")
    sent = ["300000", "299999", "600000", "900000", "x", "", None, "NaN", "Infinity"]
    got = each(texts(spark, sent), filters.within_replay_window(received, F.col("v")))
    assert got == [True, False, True, True, False, False, False, False, False]


def test_keys_name_missing_parts(spark):
    key = text.idempotency_key(F.lit("google_calendar"), F.lit("c"), F.lit(None), F.lit(7))
    assert first(spark, key) == ("google_calendar:c:undefined:7",)


def test_handshake_and_channel_token(spark):
    got = first(
        spark,
        filters.is_handshake(F.lit("sync")),
        filters.is_handshake(F.lit(None).cast("string")),
        filters.channel_token_ok(F.lit("x"), None),
        filters.channel_token_ok(F.lit("x"), "y"),
        filters.channel_token_ok(F.lit(None).cast("string"), "y"),
        filters.channel_token_ok(F.lit("y"), "y"),
    )
    assert got == (True, False, True, False, False, True)


def test_source_systems(spark):
    got = first(spark, *[outcomes.source_system(F.lit(p)) for p in ("hubspot", "stripe", "x")])
    assert got == ("crm", "payments", None)


def test_to_major(spark):
    assert first(spark, money.to_major(F.lit(150050))) == (1500.5,)
