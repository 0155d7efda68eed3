"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from revsync import vocab


def trim_ws(c: Column) -> Column:
    """Strip every kind of white space; Spark's plain trim takes off spaces only.

    A text of nothing but printable ASCII can hold no other kind, and plain trim is
    many times quicker.
    """
    return F.when(c.rlike("[^ -~]"), F.trim(c, F.lit(vocab.WHITESPACE))).otherwise(F.trim(c))


def fold_status(raw_status: Column) -> Column:
    """The form under which payment status words are compared."""
    return F.lower(trim_ws(raw_status))


def non_empty(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def idempotency_key(provider: Column, *parts: Column) -> Column:
    return F.concat_ws(
        ":", provider, *[F.coalesce(p.cast("string"), F.lit(vocab.UNDEFINED)) for p in parts]
    )


def envelope_key() -> Column:
    """The idempotency key of a webhook envelope: each provider names a delivery its own way."""
    p = F.col("provider")
    return (
        F.when(
            p == vocab.HUBSPOT, idempotency_key(p, F.col("subscription_id"), F.col("event_id"))
        )
        .when(
            p == vocab.GOOGLE_CALENDAR,
            idempotency_key(p, F.col("channel_id"), F.col("resource_id"), F.col("message_number")),
        )
        .otherwise(idempotency_key(p, F.col("event_id")))
    )


def raw_json(*columns: str) -> Column:
    """The payload, whole, as JSON text."""
    return F.to_json(F.struct(*columns))


def properties_json(names: list[str], source_id: Column) -> Column:
    """A CRM payload as JSON: its named properties plus its id, nulls included."""
    return F.to_json(
        F.struct(*names, source_id.alias("id")), {"ignoreNullFields": "false"}
    )


def landed_properties_json(line: Column, source_id: Column) -> Column:
    """All properties of a CRM object as it landed, plus its id; null if it has none."""
    landed = F.from_json(F.get_json_object(line, "$.properties"), "map<string,string>")
    others = F.map_filter(landed, lambda name, _: name != "id")
    whole = F.map_concat(others, F.create_map(F.lit("id"), source_id))
    return F.to_json(whole, {"ignoreNullFields": "false"})
