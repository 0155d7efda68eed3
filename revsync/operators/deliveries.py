"""Webhook deliveries: what became of each attempt, without replaying them one by one.

The first attempt that succeeds is processed, later ones are skipped, earlier ones
failed. So a key's state is its first success, a minimum that every task can take for
itself, and no key's attempts ever have to meet in one task in order. They don't meet
unordered either: a key is dealt by salts, or by seconds where it is ranked, and only the
minima and counts of these parts come together.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from revsync import vocab
from revsync.functions import text, times
from revsync.operators import filters

ORDER = ["received_at", "attempt"]
#: Parts that a key's attempts are dealt into; a part exists only where it has attempts.
SALTS = 1024


def _position(order: list[str]) -> Column:
    return F.struct(*order)


def _first_attempts(rows: DataFrame, keys: list[str], here: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(here).alias("_first"),
        F.min(F.when(F.col("process_ok"), here)).alias("_first_ok"),
        F.count(F.lit(1)).alias("_n"),
    )


def _judge(here: Column, ledger_status: Column) -> tuple[Column, Column]:
    """Status an attempt met, and its outcome, given its key's first attempt and success."""
    done_before = F.coalesce(ledger_status == vocab.PROCESSED, F.lit(False))
    done = done_before | F.coalesce(here > F.col("_first_ok"), F.lit(False))
    prior = (
        F.when(done, vocab.PROCESSED)
        .when(here > F.col("_first"), vocab.FAILED)
        .otherwise(ledger_status)
    )
    outcome = (
        F.when(done, vocab.DUPLICATE_SKIPPED)
        .when(F.col("process_ok"), vocab.PROCESSED)
        .otherwise(vocab.FAILED)
    )
    return prior.alias("prior_status"), outcome.alias("outcome")


def delivery_states(
    deliveries: DataFrame,
    ledger: DataFrame | None = None,
    order: list[str] | None = None,
    once: bool = False,
) -> DataFrame:
    """Each attempt with `prior_status` (null, failed or processed) and `outcome`.

    `process_ok` says whether processing that attempt works out. With a ledger, keys
    processed in earlier batches are skipped and keys that failed there go again. Where each
    key comes `once` its attempt is its own first, and nothing is shuffled to find that out.
    """
    key, order = "idempotency_key", order or ORDER
    here = _position(order)
    if once:
        rows, ledger_status = deliveries, F.lit(None).cast("string")
        if ledger is not None:
            known = ledger.select(key, F.col("processing_status").alias("_ledger"))
            rows, ledger_status = rows.join(known, key, "left"), F.col("_ledger")
        rows = rows.withColumns({"_first": here, "_first_ok": F.when(F.col("process_ok"), here)})
        return rows.select(*deliveries.columns, *_judge(here, ledger_status))
    rows = deliveries.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    whole_key = Window.partitionBy(key)
    marks = _first_attempts(rows, [key, "_salt"], here).select(
        key,
        "_salt",
        F.min("_first").over(whole_key).alias("_first"),
        F.min("_first_ok").over(whole_key).alias("_first_ok"),
    )
    ledger_status = F.lit(None).cast("string")
    if ledger is not None:
        known = ledger.select(key, F.col("processing_status").alias("_ledger"))
        marks, ledger_status = marks.join(known, key, "left"), F.col("_ledger")
    return rows.join(marks, [key, "_salt"], "left").select(
        *deliveries.columns, *_judge(here, ledger_status)
    )


def webhook_outcomes(deliveries: DataFrame) -> DataFrame:
    return delivery_states(deliveries).drop("prior_status")


def delivery_sequence(deliveries: DataFrame) -> DataFrame:
    """Each attempt's ordinal within its key, the state it met and its outcome.

    Ordinals are counted per key and second, then shifted by what the key had earlier
    in that hour and in earlier hours. The shifts come from counts, so a key with very
    many attempts is ranked by many tasks.
    """
    key, here = "idempotency_key", _position(ORDER)
    rows = deliveries.withColumn("_second", F.date_trunc("second", "received_at"))
    seconds = _first_attempts(rows, [key, "_second"], here).withColumn(
        "_hour", F.date_trunc("hour", "_second")
    )
    hours = seconds.groupBy(key, "_hour").agg(
        F.min("_first").alias("_first"),
        F.min("_first_ok").alias("_first_ok"),
        F.sum("_n").alias("_n"),
    )

    def before(w) -> Column:
        return F.coalesce(
            F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    whole_key = Window.partitionBy(key)
    by_hour = hours.select(
        key,
        "_hour",
        before(whole_key.orderBy("_hour")).alias("_hours_before"),
        F.min("_first").over(whole_key).alias("_first"),
        F.min("_first_ok").over(whole_key).alias("_first_ok"),
    )
    in_hour = seconds.select(
        key,
        "_hour",
        "_second",
        before(Window.partitionBy(key, "_hour").orderBy("_second")).alias("_in_hour"),
    )
    shift = in_hour.join(by_hour, [key, "_hour"]).drop("_hour")
    within = Window.partitionBy(key, "_second").orderBy(*ORDER)
    ordinal = F.col("_rn") + F.col("_in_hour") + F.col("_hours_before")
    return (
        rows.withColumn("_rn", F.row_number().over(within))
        .join(shift, [key, "_second"])
        .select(
            *deliveries.columns,
            ordinal.cast("bigint").alias("attempt_no"),
            *_judge(here, F.lit(None).cast("string")),
        )
    )


def ledger_rows(
    states: DataFrame,
    order: list[str] | None = None,
    now: datetime | None = None,
    once: bool = False,
) -> DataFrame:
    """The state a batch leaves each of its keys in: processed if any attempt was, else failed.

    Keys whose attempts were all skipped keep the ledger row they have. `now` is when the
    batch was processed; without it the last attempt's arrival stands for that. Where each key
    comes `once` its row is the attempt's own, with what else `states` has.
    """
    ran = states.where(F.col("outcome") != vocab.DUPLICATE_SKIPPED)
    if once:
        at = F.col("received_at") if now is None else times.at(now)
        return ran.withColumnRenamed("outcome", "processing_status").withColumn("processed_at", at)
    processed_at = F.col("_end.received_at") if now is None else times.at(now)
    here = _position(order or ORDER)
    seen = F.struct("provider", "event_type", "payload", "received_at")
    end = F.struct("outcome", "received_at", "error")
    return (
        ran.groupBy("idempotency_key")
        .agg(F.min_by(seen, here).alias("_seen"), F.max_by(end, here).alias("_end"))
        .select(
            "idempotency_key",
            "_seen.provider",
            "_seen.event_type",
            "_seen.payload",
            "_seen.received_at",
            F.col("_end.outcome").alias("processing_status"),
            processed_at.alias("processed_at"),
            "_end.error",
        )
    )


def duplicate_counts(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("outcome") == vocab.DUPLICATE_SKIPPED)
        .groupBy("provider")
        .agg(F.count(F.lit(1)).alias("duplicates"))
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("outcome").isin(vocab.PROCESSED, vocab.FAILED))
        .groupBy("provider", "outcome")
        .agg(F.count(F.lit(1)).alias("deliveries"))
    )


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """Landed envelopes with real times and their idempotency key."""
    return envelopes.withColumn("received_at", times.iso_ts(F.col("received_at"))).withColumn(
        "idempotency_key", text.envelope_key()
    )


def replay_window(envelopes: DataFrame) -> DataFrame:
    """Without CRM deliveries that are too old; other providers sign no time."""
    ok = filters.within_replay_window(F.col("received_at"), F.col("sent_at"))
    return envelopes.where((F.col("provider") != vocab.HUBSPOT) | ok)


def handshake_drop(envelopes: DataFrame, channel_token: str | None = None) -> DataFrame:
    """Without calendar handshakes and pokes that carry the wrong channel token."""
    poke_ok = ~filters.is_handshake(F.col("resource_state")) & filters.channel_token_ok(
        F.col("channel_token"), channel_token
    )
    return envelopes.where((F.col("provider") != vocab.GOOGLE_CALENDAR) | poke_ok)
