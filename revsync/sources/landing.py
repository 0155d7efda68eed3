"""Landed payloads: JSON lines or Parquet under a folder, always with an explicit schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from revsync.functions import times

CORRUPT = "_corrupt_record"
#: The payload as it landed, fields that no schema names included.
LINE = "landed_line"
#: The day of landing, where a landing folder has a folder for each.
LANDED_ON = "landed_on"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _arrival(df: DataFrame) -> DataFrame:
    """Where and when each row landed: orders rows that tell the same story twice."""
    return df.select(
        "*",
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("landed_at"),
        F.col("_metadata.file_path").alias("landed_file"),
    )


def land(payloads: DataFrame, path: str, on: Column) -> None:
    """Add payloads to a landing folder as JSON lines, in a folder for each day `on`."""
    lines = payloads.select(F.to_json(F.struct(*payloads.columns)).alias("value"), on.cast("date").alias(LANDED_ON))
    lines.hint("rebalance", LANDED_ON).write.mode("append").partitionBy(LANDED_ON).text(path)


def landed_since(landed: DataFrame, moment: datetime) -> DataFrame:
    """Payloads of files that landed at `moment` or later; other files are not opened.

    Spark prunes the folders of earlier days, and among the rest files by when they were
    written. Payloads that tell neither stay.
    """
    if LANDED_ON in landed.columns:
        landed = landed.where(F.col(LANDED_ON) >= F.lit(moment.date()))
    if "landed_at" in landed.columns:
        landed = landed.where(F.col("landed_at") >= times.at(moment))
    return landed


def read_landed(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "json"
) -> DataFrame:
    """A batch scan, with each payload whole in `landed_line`: a JSON line's text, or another
    format's row as JSON, whatever columns the files have besides the schema's. Lines that are
    no JSON come out with `_corrupt_record` filled."""
    if fmt == "json":
        return _json_lines(spark.read.format("text").load(path), schema)
    return _whole_rows(spark.read.format(fmt).option("mergeSchema", "true").load(path), schema)


def stream_landed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    max_files_per_trigger: int | None = None,
    path_glob: str | None = None,
) -> DataFrame:
    """The same scan as a stream over a landing folder."""
    reader = spark.readStream.format("text" if fmt == "json" else fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if fmt == "json":
        return _json_lines(reader.load(path), schema)
    landed = spark.read.format(fmt).option("mergeSchema", "true").load(path).schema
    return _whole_rows(reader.schema(landed).load(path), schema)


def _whole_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of files that have their own columns: those of the schema, and all of them as JSON.

    A query that doesn't ask for the JSON reads the schema's columns only.
    """
    own = [c for c in rows.columns if c != LANDED_ON]
    typed = [_shaped(F.col(f.name), rows.schema[f.name].dataType, f.dataType).alias(f.name)
             if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    landed = _arrival(rows).withColumn(LINE, F.to_json(F.struct(*own)))
    others = [c for c in (LANDED_ON, "landed_at", "landed_file", LINE) if c in landed.columns]
    return landed.select(*others, *typed, F.lit(None).cast("string").alias(CORRUPT))


def _shaped(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column with the fields that are wanted, by name at every depth."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        names = have.names
        fields = [
            (_shaped(c[f.name], have[f.name].dataType, f.dataType) if f.name in names
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _shaped(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[c[f.name].cast(f.dataType).alias(f.name) for f in want.fields]))
    if isinstance(have, (T.StructType, T.MapType)) and isinstance(want, T.StringType):
        return F.to_json(c)
    return c.cast(want)


def _json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    rows = _arrival(lines).where(F.trim("value") != "")
    return parse_landed(rows.withColumn(LINE, F.col("value")), "value", schema)


def parse_landed(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Payloads that land as JSON text in a column (a queue, a table) instead of in files."""
    parsed = F.from_json(
        column, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    others = [c for c in df.columns if c != column]
    return df.select(*others, parsed.alias("_p")).select(*others, "_p.*")


def named_properties(df: DataFrame, names: list[str]) -> DataFrame:
    """A CRM scan: id, the named properties as columns, and the object's own times."""
    return df.select(
        "id", *[F.col("properties")[n].alias(n) for n in names], "createdAt", "updatedAt"
    )
