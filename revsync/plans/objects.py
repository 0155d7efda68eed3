"""The latest landed object per id, for notifications that carry an id only.

Kept up by loads and laid out by id, so that looking objects up reads the folders of the ids
asked for, however much has landed over time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revsync.plans.store import Commit
from revsync.plans.warehouse import Warehouse
from revsync.sources import landing
from revsync.sources.registry import SourceSpec


def keep(
    warehouse: Warehouse, spec: SourceSpec, landed: DataFrame, batch_id: str, now: datetime
) -> Commit:
    """Take in landed payloads: of each id the one modified last stays, whenever it lands."""
    whole = F.to_json(F.struct(*spec.payload.names))
    if landing.LINE in landed.columns:
        whole = F.coalesce(landing.LINE, whole)
    rows = landed.where(F.col("id").isNotNull()).select(
        F.lit(spec.provider).alias("provider"),
        F.col("id").alias("source_id"),
        spec.watermark().alias("modified"),
        whole.alias("payload"),
    )
    table = warehouse.objects[spec.entity_type]
    return table.commit(rows, now, batch_id=batch_id, order=["modified", "payload"], policy="newest")


def lookup(warehouse: Warehouse, spec: SourceSpec, notifications: DataFrame) -> DataFrame:
    """Each notified object once, as its payload, in its latest version."""
    wanted = notifications.where(F.col("object_id").isNotNull()).select(
        F.lit(spec.provider).alias("provider"), F.col("object_id").alias("source_id")
    )
    found = warehouse.objects[spec.entity_type].lookup(wanted)
    lines = found.select(F.col("payload").alias(landing.LINE), F.col("payload").alias("value"))
    return landing.parse_landed(lines, "value", spec.payload)
