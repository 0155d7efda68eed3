"""Lookups by key, as joins. Big sides carry no hint: Spark measures and decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revsync import vocab
from revsync.functions import times
from revsync.operators import filters
from revsync.operators.upsert import last_per_key
from revsync.sources.registry import Registry


def latest_object(landed: DataFrame, modified: Column, order: list[str] | None = None) -> DataFrame:
    """The newest landed version of each object."""
    rows = landed.withColumn("_modified", modified)
    return last_per_key(rows, ["id"], ["_modified", *(order or [])]).drop("_modified")


def notification_to_object(notifications: DataFrame, objects: DataFrame) -> DataFrame:
    """Notifications carry an id only: join them to the object as it is now."""
    return notifications.join(
        objects.withColumnRenamed("id", "object_id"), "object_id", "inner"
    )


def refetch_by_id(
    notifications: DataFrame, landed: DataFrame, modified: Column, order: list[str] | None = None
) -> DataFrame:
    """Each notified object once, in its latest landed version."""
    ids = notifications.select(F.col("object_id").alias("id")).distinct()
    return latest_object(landed.join(ids, "id", "left_semi"), modified, order)


def failures_by_job(failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failures with the run they came from; nulls where that run is gone."""
    j = jobs.select(
        F.col("id").alias("job_id"),
        F.col("mode").alias("job_mode"),
        F.col("started_at").alias("job_started_at"),
    )
    return failures.join(j, "job_id", "left")


def _processed_keys(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("processing_status") == vocab.PROCESSED).select("idempotency_key")


def new_deliveries(deliveries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deliveries whose key was not processed yet; one that failed before goes again."""
    return deliveries.join(_processed_keys(ledger), "idempotency_key", "left_anti")


def known_deliveries(deliveries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Deliveries whose key was processed before."""
    return deliveries.join(_processed_keys(ledger), "idempotency_key", "left_semi")


def unconfigured(deliveries: DataFrame, registry: Registry) -> DataFrame:
    """Failure log rows for deliveries about a source nobody configured."""
    context = (
        F.when(F.col("provider") == vocab.HUBSPOT, F.col("object_id"))
        .when(F.col("provider") == vocab.STRIPE, F.col("event_id"))
        .otherwise(F.concat_ws(":", "channel_id", "resource_id"))
    )
    entity = delivery_entity()
    return (
        deliveries.withColumn("entity_type", entity)
        .where(F.col("entity_type").isNotNull())
        .where(~registry.is_configured(F.col("provider"), F.col("entity_type")))
        .select(
            "provider",
            "entity_type",
            F.lit(None).cast("string").alias("job_id"),
            F.lit(vocab.PROVIDER_NOT_CONFIGURED).alias("error_code"),
            F.format_string(
                vocab.NOT_CONFIGURED, F.col("provider"), F.col("entity_type"), context
            ).alias("message"),
            F.to_json(F.struct(context.alias("source"))).alias("context"),
            times.ntz(F.col("received_at")).alias("occurred_at"),
        )
    )


def delivery_entity() -> Column:
    """The entity a delivery is about: any calendar poke, otherwise by its event type."""
    return F.when(F.col("provider") == vocab.GOOGLE_CALENDAR, vocab.EVENT).otherwise(
        filters.event_entity(F.col("event_type"))
    )
