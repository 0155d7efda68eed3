"""Landed payloads to canonical rows.

Each function returns the canonical columns plus `normalize_ok`, whether the payload
could be normalised, and `normalize_error`, why not. Keeping good rows needs only the
first, which is a short predicate; the message is worked out for rejects alone.
`synced_at` is stamped once per batch, on writing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from revsync import schemas, vocab
from revsync.functions import money, text, times
from revsync.operators import status


def _epoch() -> Column:
    return times.at(times.EPOCH)


def _date_error(**texts: Column) -> Column:
    """The first of the named texts that is there but is no time."""
    return F.coalesce(
        *[
            F.when(times.bad_iso(c), F.concat(F.lit(f"{name} is not a valid date: "), c))
            for name, c in texts.items()
        ]
    )


def _dates_ok(*texts: Column) -> Column:
    ok = ~times.bad_iso(texts[0])
    for c in texts[1:]:
        ok = ok & ~times.bad_iso(c)
    return ok


def _readable(df: DataFrame) -> Column:
    if "_corrupt_record" in df.columns:
        return F.col("_corrupt_record").isNull()
    return F.lit(True)


def _unreadable(df: DataFrame) -> Column:
    return F.when(~_readable(df), "payload is not valid JSON")


def _carried(df: DataFrame) -> list[str]:
    """Columns that are not the payload's but tell how it came in."""
    known = ("arrival_seq", "landed_at", "landed_file", "watermark", "event_created")
    return [c for c in known if c in df.columns]


def _raw(df: DataFrame, built: Column, landed=lambda line: line) -> Column:
    """The payload as it landed, or as its named fields tell it where no text has landed."""
    if "landed_line" in df.columns:
        built = F.coalesce(landed(F.col("landed_line")), built)
    return built.alias("raw")


def _unpack(df: DataFrame, names: list[str]) -> DataFrame:
    """The named properties as columns."""
    corrupt = [c for c in ("_corrupt_record", "landed_line") if c in df.columns]
    properties = [F.col("properties")[n].alias(n) for n in names]
    return df.select("id", "createdAt", "updatedAt", *properties, *corrupt, *_carried(df))


def normalize_contacts(df: DataFrame, provider: str = vocab.HUBSPOT) -> DataFrame:
    df = _unpack(df, vocab.CONTACT_PROPERTIES)
    c = F.col
    return df.select(
        F.lit(provider).alias("provider"),
        c("id").alias("source_id"),
        "email",
        c("firstname").alias("first_name"),
        c("lastname").alias("last_name"),
        "phone",
        "company",
        c("lifecyclestage").alias("lifecycle_stage"),
        times.iso_ts_or(c("createdate"), c("createdAt")).alias("source_created_at"),
        times.iso_ts_or(c("lastmodifieddate"), c("updatedAt")).alias("source_updated_at"),
        _raw(
            df, text.properties_json(vocab.CONTACT_PROPERTIES, c("id")),
            lambda line: text.landed_properties_json(line, c("id")),
        ),
        (_readable(df) & _dates_ok(c("createdate"), c("lastmodifieddate"))).alias("normalize_ok"),
        F.coalesce(
            _unreadable(df),
            _date_error(createdate=c("createdate"), lastmodifieddate=c("lastmodifieddate")),
        ).alias("normalize_error"),
        *_carried(df),
    )


def normalize_deals(df: DataFrame, provider: str = vocab.HUBSPOT) -> DataFrame:
    df = _unpack(df, vocab.DEAL_PROPERTIES)
    df = df.withColumn("_minor", money.amount_to_minor(F.col("amount")))
    c = F.col
    dates = {n: c(n) for n in ("closedate", "createdate", "hs_lastmodifieddate")}
    no_amount = text.is_blank(c("amount"))
    currency = F.lit(vocab.DEAL_CURRENCY)
    return df.select(
        F.lit(provider).alias("provider"),
        c("id").alias("source_id"),
        F.coalesce("dealname", F.lit(vocab.UNTITLED_DEAL)).alias("deal_name"),
        F.coalesce("dealstage", F.lit(vocab.UNKNOWN_STAGE)).alias("stage"),
        c("_minor").alias("amount_minor"),
        F.when(~no_amount, currency).alias("currency"),
        "pipeline",
        times.iso_ts(c("closedate")).alias("close_date"),
        F.lit(None).cast("string").alias("primary_contact_source_id"),
        times.iso_ts_or(c("createdate"), c("createdAt")).alias("source_created_at"),
        times.iso_ts_or(c("hs_lastmodifieddate"), c("updatedAt")).alias("source_updated_at"),
        _raw(
            df, text.properties_json(vocab.DEAL_PROPERTIES, c("id")),
            lambda line: text.landed_properties_json(line, c("id")),
        ),
        (
            _readable(df)
            & (no_amount | F.coalesce(c("_minor") >= 0, F.lit(False)))
            & _dates_ok(*dates.values())
        ).alias("normalize_ok"),
        F.coalesce(
            _unreadable(df),
            F.when(~no_amount, money.money_error(c("_minor"), currency, vocab.NOT_A_NUMBER)),
            _date_error(**dates),
        ).alias("normalize_error"),
        *_carried(df),
    )


def normalize_attendees(attendees: Column) -> Column:
    """Attendees with a missing address as empty text; no list at all is an empty list."""
    return F.coalesce(
        F.transform(
            attendees,
            lambda a: F.struct(
                F.coalesce(a["email"], F.lit("")).alias("email"),
                a["responseStatus"].alias("response_status"),
            ),
        ),
        F.array().cast("array<struct<email:string,response_status:string>>"),
    )


def normalize_calendar(df: DataFrame, provider: str = vocab.GOOGLE_CALENDAR) -> DataFrame:
    # A start that is there but empty still wins over the original start.
    original = times.event_time_text(F.col("originalStartTime"))
    df = df.withColumns(
        {
            f"_{name}": F.when(F.col(name).isNull(), original).otherwise(
                times.event_time_text(F.col(name))
            )
            for name in ("start", "end")
        }
    )
    start, end, c = times.iso_ts(F.col("_start")), times.iso_ts(F.col("_end")), F.col
    dates = {"start": c("_start"), "end": c("_end"), "created": c("created"), "updated": c("updated")}
    recurring_id = c("recurringEventId")
    return df.select(
        F.lit(provider).alias("provider"),
        F.coalesce("id", F.lit("")).alias("source_id"),
        F.coalesce("summary", F.lit(vocab.NO_TITLE)).alias("title"),
        "description",
        "location",
        F.coalesce(start, _epoch()).alias("start_at"),
        F.coalesce(end, start, _epoch()).alias("end_at"),
        c("start")["timeZone"].alias("timezone"),
        F.coalesce("status", F.lit(vocab.DEFAULT_EVENT_STATUS)).alias("status"),
        c("organizer")["email"].alias("organizer_email"),
        normalize_attendees(c("attendees")).alias("attendees"),
        (~text.is_blank(recurring_id) | (F.coalesce(F.size("recurrence"), F.lit(0)) > 0)).alias(
            "is_recurring"
        ),
        recurring_id.alias("recurring_event_source_id"),
        times.iso_ts(c("created")).alias("source_created_at"),
        times.iso_ts(c("updated")).alias("source_updated_at"),
        _raw(df, text.raw_json(*schemas.CALENDAR_EVENT.names)),
        (_readable(df) & _dates_ok(*dates.values())).alias("normalize_ok"),
        F.coalesce(_unreadable(df), _date_error(**dates)).alias("normalize_error"),
        *_carried(df),
    )


def customer_ref(customer: Column) -> Column:
    """A customer given as an id, or as an object with one."""
    return F.when(
        customer.startswith("{"), F.get_json_object(customer, "$.id")
    ).otherwise(customer)


def normalize_payments(
    df: DataFrame, mapping: DataFrame, provider: str | Column = vocab.STRIPE
) -> DataFrame:
    created = times.unix_ts(F.col("created"))
    rows = df.select(
        (F.lit(provider) if isinstance(provider, str) else provider).alias("provider"),
        F.col("id").alias("source_id"),
        F.col("amount").alias("amount_minor"),
        money.normalize_currency(F.col("currency")).alias("currency"),
        F.col("status").alias("raw_status"),
        customer_ref(F.col("customer")).alias("customer_ref"),
        created.alias("occurred_at"),
        "description",
        created.alias("source_created_at"),
        created.alias("source_updated_at"),
        _raw(df, text.raw_json(*schemas.PAYMENT_INTENT.names)),
        (_readable(df) & money.is_money(F.col("amount"), F.col("currency"))).alias("normalize_ok"),
        F.coalesce(
            _unreadable(df), money.money_error(F.col("amount"), F.col("currency"))
        ).alias("normalize_error"),
        *_carried(df),
    )
    return status.map_status(rows, mapping)


def payment_events(envelopes: DataFrame) -> DataFrame:
    """The payment objects inside payment webhooks; other events carry none."""
    intents = envelopes.where(F.col("event_type").startswith(vocab.PAYMENT_INTENT_PREFIX))
    parsed = F.from_json("object", schemas.PAYMENT_INTENT)
    others = [c for c in envelopes.columns if c != "object"]
    return intents.select(*others, parsed.alias("_o")).select(
        *others, *[F.col("_o")[n].alias(n) for n in schemas.PAYMENT_INTENT.names]
    )


def normalize_payment_event(
    envelopes: DataFrame, mapping: DataFrame, provider: str | Column = vocab.STRIPE
) -> DataFrame:
    """As a payment, but updated when the event fired: that is when its status changed."""
    rows = normalize_payments(payment_events(envelopes), mapping, provider)
    return rows.withColumn("source_updated_at", times.unix_ts(F.col("event_created"))).drop(
        "event_created"
    )


def stamp_synced_at(df: DataFrame, batch_time: datetime) -> DataFrame:
    """One write time for the whole batch."""
    return df.withColumn("synced_at", times.at(batch_time))


def route_kinds(df: DataFrame, kind: str = "kind") -> dict[str, DataFrame]:
    """Records tagged with a kind, one DataFrame per table; an unknown kind fails the job."""
    checked = df.withColumn(
        kind,
        F.when(F.col(kind).isin(vocab.ENTITY_TYPES), F.col(kind)).otherwise(
            F.raise_error(
                F.concat(F.lit("unhandled record kind: "), F.coalesce(kind, F.lit("null")))
            )
        ),
    )
    return {k: checked.where(F.col(kind) == k) for k in vocab.ENTITY_TYPES}
