"""Small dimensions: providers and the payment status mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revsync import vocab
from revsync.functions import outcomes


def _values(spark: SparkSession, rows: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """Rows inline in the plan, so that Spark knows how small they are."""
    texts = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {texts} as t({', '.join(columns)})")


def provider_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (p, system, vocab.PROVIDER_DISPLAY_NAME[p])
        for p, system in vocab.PROVIDER_SOURCE_SYSTEM.items()
    ]
    return _values(spark, rows, ["provider", "source_system", "display_name"])


def status_mapping_seed(spark: SparkSession) -> DataFrame:
    return _values(
        spark, vocab.STATUS_MAPPING_SEED, ["provider", "raw_status", "canonical_status"]
    )


def check_status_map(mapping: DataFrame) -> DataFrame:
    """The mapping, failing the job on a row whose provider or status is not known."""
    bad = ~(
        outcomes.is_provider(F.col("provider"))
        & outcomes.is_payment_status(F.col("canonical_status"))
    )
    message = F.concat_ws(
        " ",
        F.lit("bad payment status mapping:"),
        "provider",
        "raw_status",
        "canonical_status",
    )
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message)).otherwise(
        F.col("canonical_status")
    )
    return mapping.select("provider", "raw_status", checked.alias("canonical_status"))
