"""What several operators share: reading tables, staging, words, connected components."""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revsync import session
from revsync.session import scratch, shared_dir, stage_at

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what separates words: all of ASCII but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; a pure ASCII text takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: `node`, `component` (its smallest node).

    Large-star and small-star in turn until each component is a star around its smallest node,
    which the minima that a round begins with tell; each step is written out, so the lineage
    stays short and a lost executor costs one step. A hub is no bottleneck:
    minima are combined before the shuffle, and the join with them has an exchange on
    both sides, so that adaptive execution can split the hub. Nodes without an edge to
    another node do not come out; nulls link nothing.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a <> b")
        .distinct()
    )
    e = stage(e, "edges")
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(
            F.least("a", F.min("b")).alias("m"),
            # Of a star's nodes only the smallest has several neighbours.
            ((F.min("b") < F.col("a")) & (F.count("*") > 1)).alias("open"),
        )
        low = stage(low, "low")
        if not low.agg(F.bool_or("open")).first()[0]:
            return low.select(F.col("a").alias("node"), F.col("m").alias("component"))
        e = stage(
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "edges",
        )
        low = stage(e.groupBy("a").agg(F.min("b").alias("m")), "low")
        # A node's edge to its smallest neighbour stays, each other neighbour goes there too.
        least = F.col("b") == F.col("m")
        e = stage(
            e.join(low, "a").select(F.when(least, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def extended(found: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """The components once `edges` have come to those of which `components` gave `found`.

    Components become the nodes, so the work is that of the new edges alone.
    """
    x, y = (found.select(F.col("node").alias(f"{s}n"), F.col("component").alias(f"{s}c")) for s in "xy")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    ends = ends.join(x, F.col("x") == F.col("xn"), "left").join(y, F.col("y") == F.col("yn"), "left")
    more = components(ends.select(F.coalesce("xc", "x").alias("x"), F.coalesce("yc", "y").alias("y")), "x", "y")
    now = more.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = found.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stage(moved.unionAll(more.join(found, "node", "left_anti")), "components")


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if it has at most `rows` rows; beyond that a join shuffles it.

    `df` should be staged, since it is counted here.
    """
    return F.broadcast(df) if df.count() <= rows else df


_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("scope", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` out once and read it back; within `scoped` only until that block ends."""
    folder = _scope.get()
    return session.stage(df, name) if folder is None else stage_at(df, f"{folder}/{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def scoped(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What operators stage within the block goes when it ends, whatever the outcome, and what
    its queries shuffle when they end.

    Gives a function that stages what is to outlive the block; within another such block
    it goes with that.
    """
    session.small_batches(spark)
    outer = _scope.get()

    def keep(df: DataFrame, name: str) -> DataFrame:
        return session.stage(df, name) if outer is None else stage_at(df, f"{outer}/{name}-{uuid.uuid4().hex}")

    with scratch(spark, f"{shared_dir(spark)}/revsync") as folder:
        token = _scope.set(folder)
        try:
            with session.shuffles_removed(spark):
                yield keep
        finally:
            _scope.reset(token)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like `stage` whose folders go when the block ends, whatever the outcome.

    A result that is to outlive the block has to be staged by itself within it.
    """
    with scratch(spark, f"{shared_dir(spark)}/revsync") as folder:
        yield lambda df, name: stage_at(df, f"{folder}/{name}")


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Rows of sorted batches by runs of one first column: its value, and the others' tuples.

    Only a batch is held at a time, however long a run is.
    """
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    return ((k, (r[1:] for r in some)) for k, some in groupby(rows, key=itemgetter(0)))


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of `size`."""
    rows = iter(rows)
    while some := list(islice(rows, size)):
        columns = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digest_runs(rows: DataFrame, key: str, order: str, value: str, between: str) -> DataFrame:
    """SHA-256 of each key's values, in order and joined by `between`: `key`, `sha256`, `n`.

    `value` is a column of strings without nulls. A key's values pass through one task, since
    the digest is a chain, but are hashed as they come and never held together.
    """
    columns = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    fields = [columns.schema["k"], T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType())]
    schema = to_arrow_schema(T.StructType(fields))

    def digests(batches):
        for k, some in runs(batches):
            h, n = hashlib.sha256(), 0
            for (v,) in some:
                h.update(((between if n else "") + v).encode())
                n += 1
            yield k, h.hexdigest(), n

    def run(batches):
        yield from batched(digests(batches), schema)

    ordered = columns.repartition("k").sortWithinPartitions("k", "o").select("k", "v")
    return ordered.mapInArrow(run, T.StructType(fields)).withColumnRenamed("k", key)
