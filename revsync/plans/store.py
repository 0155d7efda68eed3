"""Canonical tables on plain Parquet: keyed upserts that commit together with their cursor.

A commit writes the batch's rows (a delta) to a folder of its own and then one small commit
row that names the delta, the cursor and the batch. Readers go by commit rows only, so data
and cursor appear together or not at all, and a job that dies half-way leaves nothing
visible. Commit rows are numbered; who finds a number taken reads the table again, redoes
its outcomes and takes the next one. Should two writers still get the same number, which a
store without exclusive renames allows, both rows stand, in the order of their deltas' names.

A load writes what its batch holds and never rewrites the base. Rows lie in folders by a hash
of their key, and to tell new rows from old a load reads those of its batch's keys. After some loads their deltas are folded into one, which costs
what those deltas hold; `compact` makes a new base of everything.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from revsync import session, vocab
from revsync.functions import times
from revsync.operators import upsert, validate
from revsync.schemas import COMMIT

#: The folders that rows lie in: by a hash of their key, and deltas by the commit that wrote them.
BUCKET = "key_bucket"
_FOLDERS = [T.StructField("data", T.StringType()), T.StructField(BUCKET, T.IntegerType())]
_VERSIONED = T.StructType([*COMMIT.fields, T.StructField("version", T.IntegerType())])


@dataclass(frozen=True)
class Cursor:
    provider: str
    entity_type: str
    token: str
    issued_at: datetime
    expires_at: datetime | None = None

    def __post_init__(self):
        if not self.token or not self.token.strip():
            raise ValueError("a cursor token must not be blank")


@dataclass(frozen=True)
class Commit:
    version: int
    created: int = 0
    updated: int = 0
    unchanged: int = 0
    repeated: bool = False  # this batch had been committed before; nothing was written

    @property
    def upserted(self) -> int:
        return self.created + self.updated


class Table:
    """A keyed table below `root`, a folder all executors can reach.

    Rows are laid out in `buckets` folders by a hash of their key. `month_of` names the time
    column by whose month the base is laid out as well, so that a date range reads only its
    months; within files rows are sorted by that column. `fold_after` is how many deltas may pile up before they are folded into one.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        keys: list[str] | None = None,
        updated: str = "source_updated_at",
        month_of: str | None = None,
        fold_after: int = 32,
        buckets: int = 16,
        name: str | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.keys = keys or upsert.KEY
        self.updated = updated
        self.month_of = month_of
        self.fold_after = fold_after
        self.buckets = buckets
        self.name = name

    # ---- commit rows -------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per commit: a log of loads, not of data."""
        try:
            return self.spark.read.schema(_VERSIONED).json(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return session.empty(self.spark, _VERSIONED)

    def _versions(self, upto: int | None = None) -> tuple[int, str | None, list[str]]:
        """Newest version, the newest base's folder and the deltas to lay over it, in order.

        Only rows since the newest base or fold come to the driver.
        """
        rows = self.commits()
        if upto is not None:
            rows = rows.where(F.col("version") <= upto)
        last = F.struct("covers", "version", "data")
        top = rows.agg(
            F.max("version").alias("version"),
            F.max(F.when(F.col("kind") == "base", last)).alias("base"),
            F.max(F.when(F.col("kind") == "fold", last)).alias("fold"),
        ).first()
        covers = top.base.covers if top.base else 0
        deltas = []
        if top.fold and top.fold.covers > covers:
            covers, deltas = top.fold.covers, [top.fold.data]
        since = rows.where((F.col("kind") == "delta") & (F.col("version") > covers))
        deltas += [r.data for r in since.select("data").orderBy("data").collect()]
        return top.version or 0, top.base.data if top.base else None, deltas

    @staticmethod
    def _name(version: int) -> str:
        """A folder that no other writer has, in the order of versions."""
        return f"{version:012d}-{uuid.uuid4().hex}"

    def _commit(self, version: int, values: dict[str, Any]) -> None:
        """Write the commit row of a version; fails if the version is taken."""

        def cell(f: T.StructField) -> Column:
            v = values.get(f.name)
            c = times.at(v) if isinstance(v, datetime) else F.lit(v)
            return c.cast(f.dataType).alias(f.name)

        row = self.spark.range(0, 1, 1, 1).select(*[cell(f) for f in COMMIT.fields])
        row.write.mode("error").json(f"{self.root}/commits/version={version}")

    def _commit_next(self, values: dict[str, Any]) -> int:
        """Write a commit row that depends on no other, under the next free version."""
        while True:
            version = self._versions()[0] + 1
            try:
                self._commit(version, values)
                return version
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise

    def cursor(self, provider: str, entity_type: str) -> Cursor | None:
        """The cursor of a source as of its last commit; None if there is none or it was cleared."""
        row = (
            self.commits()
            .where((F.col("provider") == provider) & (F.col("entity_type") == entity_type))
            .where(F.col("kind").isin("delta", "clear"))
            .orderBy(F.desc("version"))
            .select("token", "issued_at", "expires_at")
            .first()
        )
        if row is None or row.token is None:
            return None
        return Cursor(provider, entity_type, row.token, row.issued_at, row.expires_at)

    def clear_cursor(self, provider: str, entity_type: str, now: datetime) -> None:
        self._commit_next(
            {"kind": "clear", "committed_at": now, "provider": provider, "entity_type": entity_type}
        )

    # ---- rows --------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str, *first: str, sort: Column | None = None) -> None:
        """Rows in a folder for each bucket, below one for each value of `first`. Even sizes
        come from a rebalance, which splits what is too big for one file and gathers what is
        too small."""
        rows = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", *first, BUCKET)
        if sort is not None:
            rows = rows.sortWithinPartitions(*first, BUCKET, sort)
        rows.write.partitionBy(*first, BUCKET).parquet(path)

    def _in(self, rows: DataFrame, buckets: list[int] | None) -> DataFrame:
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows' keys: at most as many numbers as there are buckets."""
        found = rows.select(self._bucket().alias(BUCKET)).distinct().collect()
        return sorted(r[0] for r in found)

    def _delta(self, names: list[str], buckets: list[int] | None = None) -> DataFrame | None:
        """The newest row of each key among some deltas."""
        if not names:
            return None
        schema = T.StructType([*self.schema.fields, *_FOLDERS])
        rows = (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.root}/deltas")
            .parquet(*[f"{self.root}/deltas/data={x}" for x in names])
        )
        rows = self._in(rows, buckets)
        if len(names) > 1:  # a single delta holds each key once
            rows = upsert.last_per_key(rows, self.keys, ["data"])
        return rows.select(*self.schema.names)

    def _base(
        self,
        name: str | None,
        start: datetime | None,
        end: datetime | None,
        buckets: list[int] | None = None,
    ) -> DataFrame | None:
        if name is None:
            return None
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if self.month_of:
            schema = schema.add("month", T.StringType())
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/bases/data={name}")
        rows = self._in(rows, buckets)
        if self.month_of and start is not None:
            rows = rows.where(F.col("month") >= start.strftime("%Y-%m"))
        if self.month_of and end is not None:
            rows = rows.where(F.col("month") <= end.strftime("%Y-%m"))
        return rows.select(*self.schema.names)

    def read(
        self,
        start: datetime | None = None,
        end: datetime | None = None,
        version: int | None = None,
        buckets: list[int] | None = None,
    ) -> DataFrame:
        """The table as of a version: the base with its deltas' rows in place of its own.

        With `buckets` only those come out, and no other folder is read. `start` and `end` prune months of the base; rows of the range's first and last
        month outside it still come out, so filter by the exact range as well.
        """
        _, base_name, deltas = self._versions(version)
        base = self._base(base_name, start, end, buckets)
        delta = self._delta(deltas, buckets)
        if delta is None:
            return base if base is not None else session.empty(self.spark, self.schema)
        if base is None:
            return delta
        return upsert.upsert_snapshot(base, delta, self.keys)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys, from the folders that can have them."""
        return upsert.point_lookup(self.read(buckets=self.buckets_of(wanted)), wanted, self.keys)

    def commit(
        self,
        batch: DataFrame,
        now: datetime,
        cursor: Cursor | None = None,
        batch_id: str | None = None,
        source: tuple[str, str] | None = None,
        order: list[str | Column] | None = None,
        policy: str = "arrival",
    ) -> Commit:
        """Upsert a batch. Repeating a `batch_id` changes nothing and reports the first time.

        A batch holds each key once, or `order` says which of its rows is the last. One that
        brings its rows' `outcome`, as a stream with keyed state can, spares reading the table.
        """
        keys = batch.select(*self.keys)
        if order:
            batch = upsert.last_per_key(batch, self.keys, order)
        while True:
            done = self._done(batch_id)
            if done is not None:
                return done
            version, base, deltas = self._versions()
            rows = batch
            if "outcome" not in batch.columns:
                # An empty table has no folders, and keys alone tell which ones others need.
                target = self.read(buckets=self.buckets_of(keys) if base or deltas else None)
                if policy == "newest":
                    rows = upsert.newest_only(rows, target, self.keys, self.updated)
                rows = upsert.upsert_outcomes(
                    rows.select(*self.schema.names), target, self.keys, self.updated
                )
            rows = rows.select(*self.schema.names, "outcome")
            if self.name:
                rows = validate.enforce(rows, self.name)
            name = self._name(version + 1)
            self._write(rows, f"{self.root}/deltas/data={name}")
            changes = self._changes(name)
            if not order and not changes.groupBy(*self.keys).count().where("count > 1").isEmpty():
                raise ValueError("a batch without an order must hold each key once")
            counts = {r.outcome: r["rows"] for r in upsert.upsert_summary(changes).collect()}
            done = Commit(version + 1, *[counts.get(k, 0) for k in _COUNTED])
            values = {
                "kind": "delta",
                "batch_id": batch_id,
                "committed_at": now,
                "created": done.created,
                "updated": done.updated,
                "unchanged": done.unchanged,
                "data": name,
            }
            if cursor is not None:
                values.update(
                    provider=cursor.provider,
                    entity_type=cursor.entity_type,
                    token=cursor.token,
                    issued_at=cursor.issued_at,
                    expires_at=cursor.expires_at,
                )
            try:
                self._commit(version + 1, values)
                break
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
        if len(self._versions()[2]) > self.fold_after:
            self.fold(now)
        return done

    def _done(self, batch_id: str | None) -> Commit | None:
        """The commit of a batch, if there has been one."""
        if batch_id is None:
            return None
        r = self.commits().where(F.col("batch_id") == batch_id).orderBy("version").first()
        return Commit(r.version, r.created, r.updated, r.unchanged, True) if r else None

    def _changes(self, name: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("outcome", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/deltas/data={name}")
        return rows.select(*schema.names)

    def changes(self, version: int) -> DataFrame:
        """The rows of one commit with their `outcome`."""
        mine = (F.col("version") == version) & (F.col("kind") == "delta")
        return self._changes(self.commits().where(mine).orderBy("data").first().data)

    def fold(self, now: datetime) -> int:
        """Make one delta of all since the base; the base itself stays as it is.

        It stands in the order of the last version it covers, before any that came since.
        """
        version, _, deltas = self._versions()
        name = self._name(version)
        self._write(self._delta(deltas), f"{self.root}/deltas/data={name}")
        return self._commit_next(
            {"kind": "fold", "committed_at": now, "data": name, "covers": version}
        )

    def compact(self, now: datetime) -> int:
        """Fold all deltas into a new base."""
        version = self._versions()[0]
        rows = self.read(version=version)
        name = self._name(version + 1)
        path = f"{self.root}/bases/data={name}"
        if self.month_of:
            t = F.col(self.month_of)
            self._write(rows.withColumn("month", F.date_format(t, "yyyy-MM")), path, "month", sort=t)
        else:
            self._write(rows, path)
        return self._commit_next(
            {"kind": "base", "committed_at": now, "data": name, "covers": version}
        )


_COUNTED = (vocab.CREATED, vocab.UPDATED, vocab.UNCHANGED)


class Log:
    """An append-only table: runs, failures, audit rows.

    Every batch has a folder of its own, so writers don't meet, and writing a batch again
    replaces it. A log with a `name` keeps that table's rules.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, name: str | None = None):
        self.spark, self.path, self.schema, self.name = spark, path, schema, name

    def append(self, rows: DataFrame, batch_id: str | None = None) -> None:
        batch = re.sub(r"[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", batch_id or uuid.uuid4().hex)
        rows = rows.select(*self.schema.names)
        if self.name:
            rows = validate.enforce(rows, self.name)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return session.empty(self.spark, self.schema)
