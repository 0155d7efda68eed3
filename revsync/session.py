"""Session settings this package relies on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def prepare(spark: SparkSession) -> SparkSession:
    """Set what this package relies on. Call before building or starting anything."""
    # Zone-less times are UTC throughout; the session must read them that way.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM compiles no method beyond 8000 bytes. A stage whose code is longer runs
    # many times faster split into single expressions than as one interpreted method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand tasks' Python rows by 2 MB at most, and not by 10,000 texts whatever their size."""
    was = spark.conf.get(_BATCH).strip().lower().rstrip("b")
    if not was.isdigit() or int(was) > _BATCH_BYTES:  # a size without a unit is in bytes
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session that names none gets one of this machine's own.
    """
    global _local_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="revsync-")
    return _local_dir


def new_scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, never used before."""
    return f"{shared_dir(spark)}/revsync/{name}-{uuid.uuid4().hex}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, and Spark knows it, so that joins with it fold away."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*nulls).where(F.lit(False))


def stage(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write `df` out once and read it back: cuts lineage, survives a lost executor.

    Parquet rather than checkpoint(), so later readers still prune columns and filters.
    Pass `spark` inside a stream, whose own session runs without adaptive execution.
    """
    return stage_at(df, new_scratch(spark or df.sparkSession, name), spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own intermediate data."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, root: str) -> Iterator[str]:
    """A folder below `root` for the intermediate data of one job, removed when it ends."""
    path = f"{root.rstrip('/')}/_scratch/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block the shuffle files of a query go when it ends. Otherwise they lie on
    the executors' disks until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


@contextlib.contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Within the block a join builds a hash table instead of sorting both sides, where every
    shuffled partition of a side measures no more than Spark's advisory size of one."""
    before, size = spark.conf.get(_HASHED), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(_HASHED, size)
    try:
        yield
    finally:
        spark.conf.set(_HASHED, before)


def stage_at(df: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """As `stage`, at a path of the caller's."""
    spark = spark or df.sparkSession
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
