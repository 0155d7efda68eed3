"""Provider payment words to canonical statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from revsync import vocab
from revsync.functions.text import fold_status


def folded_status_map(mapping: DataFrame) -> DataFrame:
    """One row per (provider, folded word); of rows folding to one word the last one wins."""
    last = Window.partitionBy("map_provider", "map_status").orderBy(F.desc("raw_status"))
    return (
        mapping.select(
            F.col("provider").alias("map_provider"),
            fold_status(F.col("raw_status")).alias("map_status"),
            "raw_status",
            F.col("canonical_status").alias("mapped_status"),
        )
        .withColumn("_rn", F.row_number().over(last))
        .where("_rn = 1")
        .drop("_rn", "raw_status")
    )


def map_status(payments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Set `canonical_status` from (provider, raw_status); a word without a mapping is unknown.

    The mapping carries no broadcast hint: Spark broadcasts it while it measures
    small and joins by shuffle, splitting hot words, should it ever not be.
    """
    m = folded_status_map(mapping)
    kept = [c for c in payments.columns if c != "canonical_status"]
    joined = payments.select(*kept).join(
        m,
        (F.col("provider") == m.map_provider)
        & (fold_status(F.col("raw_status")) == m.map_status),
        "left",
    )
    return joined.select(
        *kept, F.coalesce("mapped_status", F.lit(vocab.UNKNOWN)).alias("canonical_status")
    )


def remap(payments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply an edited mapping to stored payments, which keep the status they came in with."""
    return map_status(payments, mapping).select(*payments.columns)
