"""Upserts as set operations: one join per batch instead of a read and a write per record."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from revsync import vocab
from revsync.functions import outcomes, times

KEY = ["provider", "source_id"]


def last_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each key that comes last in `order`.

    `row_number() = 1` is cut down to one row per key in every task before the
    shuffle (window group limit), so a key with very many copies stays cheap.
    """
    descending = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    w = Window.partitionBy(*keys).orderBy(*descending)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def batch_last_write(batch: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Of several rows with one key in a batch the last to arrive is written."""
    return last_per_key(batch, keys, ["arrival_seq"])


def upsert_lookup(
    batch: DataFrame, target: DataFrame, keys: list[str] = KEY, updated: str = "source_updated_at"
) -> DataFrame:
    """Batch rows with what the target holds for their key.

    The target is first cut to the batch's keys. That semi-join sends the batch to the
    target's tasks while the batch measures small, so the table itself is not shuffled.
    """
    existing = target.select(*keys, F.col(updated).alias("existing_updated_at")).join(
        batch.select(*keys), keys, "left_semi"
    )
    return batch.join(existing.withColumn("_found", F.lit(True)), keys, "left").select(
        *batch.columns,
        F.coalesce("_found", F.lit(False)).alias("row_exists"),
        "existing_updated_at",
    )


def upsert_outcomes(
    batch: DataFrame, target: DataFrame, keys: list[str] = KEY, updated: str = "source_updated_at"
) -> DataFrame:
    """The batch with `outcome`: created, updated or unchanged."""
    return upsert_lookup(batch, target, keys, updated).select(
        *batch.columns,
        outcomes.classify_outcome(
            F.col("row_exists"), F.col("existing_updated_at"), F.col(updated)
        ).alias("outcome"),
    )


def upsert_summary(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def upsert_snapshot(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str] = KEY,
    policy: str = "arrival",
    updated: str = "source_updated_at",
) -> DataFrame:
    """The target after the batch (one row per key on either side).

    policy 'arrival': the batch row is written even when older or unchanged.
    policy 'newest': it is written unless the target's row is newer.
    """
    columns = target.columns
    if policy == "arrival":
        return target.join(batch.select(*keys), keys, "left_anti").select(*columns).unionByName(
            batch.select(*columns)
        )
    if policy != "newest":
        raise ValueError(f"unknown upsert policy {policy!r}")
    both = target.withColumn("_from_batch", F.lit(0)).unionByName(
        batch.select(*columns).withColumn("_from_batch", F.lit(1))
    )
    return last_per_key(both, keys, [updated, "_from_batch"]).select(*columns)


def newest_only(
    batch: DataFrame, target: DataFrame, keys: list[str] = KEY, updated: str = "source_updated_at"
) -> DataFrame:
    """Batch rows that are not older than the target's row (for policy 'newest')."""
    looked_up = upsert_lookup(batch, target, keys, updated)
    older = F.coalesce(F.col(updated) < F.col("existing_updated_at"), F.lit(False))
    return looked_up.where(~older).select(*batch.columns)


def audit_rows(
    outcome_rows: DataFrame, entity_type: str, job_id: str | None, occurred_at: datetime
) -> DataFrame:
    """A snapshot of each row an upsert created or updated."""
    snapshot = [c for c in outcome_rows.columns if c not in ("outcome", "arrival_seq")]
    return outcome_rows.where(F.col("outcome").isin(vocab.AUDIT_OPERATIONS)).select(
        F.lit(entity_type).alias("entity_type"),
        "provider",
        "source_id",
        F.col("outcome").alias("operation"),
        F.lit(job_id).cast("string").alias("job_id"),
        times.at(occurred_at).alias("occurred_at"),
        F.to_json(F.struct(*snapshot)).alias("snapshot"),
    )


def point_lookup(table: DataFrame, wanted: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows of the table for a set of keys."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def upsert_mapping(mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """The status mapping after edits; the key is the provider's word as written."""
    return upsert_snapshot(mapping, edits, ["provider", "raw_status"])


# ---- cursors ---------------------------------------------------------------

CURSOR_KEY = ["provider", "entity_type"]


def cursor_upsert(cursors: DataFrame, issued: DataFrame) -> DataFrame:
    """The cursor table after new cursors were issued; a blank token fails the job."""
    blank = F.coalesce(F.trim("token") == "", F.lit(True))
    token = F.when(blank, F.raise_error(F.lit("a cursor token must not be blank"))).otherwise(
        F.col("token")
    )
    return upsert_snapshot(cursors, issued.withColumn("token", token), CURSOR_KEY)


def cursor_clear(cursors: DataFrame, cleared: DataFrame) -> DataFrame:
    """Without the cleared cursors: their sources load in full next time."""
    return cursors.join(cleared.select(*CURSOR_KEY), CURSOR_KEY, "left_anti").select(
        *cursors.columns
    )


def max_watermark(
    landed: DataFrame, modified: Column, keys: list[str], prior: DataFrame | None = None
) -> DataFrame:
    """The new watermark per source: the latest modification seen, never behind the prior one."""
    seen = landed.select(*keys, modified.alias("watermark"))
    if prior is not None:
        seen = seen.unionByName(prior.select(*keys, "watermark"))
    return seen.groupBy(*keys).agg(F.max("watermark").alias("watermark"))
