"""The webhook feed: a delivery is processed with success at most once, and retried if not.

Per batch: keys already processed are skipped, the rest is normalised and validated as a set,
good rows are upserted, and last of all the ledger is committed. A crash in between replays
the batch: tables that have its id skip it, the others catch up.

A batch on its own looks keys up in the ledger. As a stream the keys are Spark's keyed state:
a streaming aggregate holds each key's first success and latest attempt, combined in every
task before the shuffle, so that neither the ledger is read nor a key's attempts have to meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from revsync import schemas, session, vocab
from revsync.operators import deliveries as ops, lookups, normalize, upsert, validate
from revsync.plans import objects
from revsync.plans.incremental import append_failures, normalized
from revsync.plans.warehouse import Warehouse
from revsync.sources import landing
from revsync.sources.registry import Registry, SourceSpec
from revsync.streaming.incremental import utc_now

# Order of attempts inside a micro-batch. The payload settles ties the same way in a
# replay; exact copies are told apart by their number and need no order.
ORDER = ["received_at", "attempt", "payload", "delivery_id"]

#: What else of a delivery its outcome is told with, where it has it.
ABOUT = ["entity_type", "object_id", "event_id", "channel_id", "resource_id", "fate", "seen_before"]

#: What is known of an attempt's fate when it arrives.
OK, FAILED, OPEN = "ok", "failed", "open"
PROCESSED = T.StructType(
    [T.StructField("idempotency_key", T.StringType()), T.StructField("at", T.TimestampType())]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _judge(rows: DataFrame, rules: list[validate.Rule]) -> DataFrame:
    ok = validate.is_valid(rules)
    return rows.select(
        "*", ok.alias("process_ok"), F.when(~ok, validate.reject_message(rules)).alias("error")
    )


def _verdict(rows: DataFrame, ok: Column, error: Column) -> DataFrame:
    """A delivery, whether it can be processed, and if not why."""
    return rows.select(
        "idempotency_key",
        "provider",
        "event_type",
        *ORDER,
        *[c for c in ABOUT if c in rows.columns],
        F.coalesce(ok, F.lit(False)).alias("process_ok"),
        error.cast("string").alias("error"),
    )


class WebhookProcessor:
    """Processes micro-batches of envelopes (see schemas.ENVELOPE) for the configured sources.

    `objects` gives, per source, all landed payloads a notification may point to. Without it
    notified objects are looked up in the warehouse's latest ones, which loads keep.
    `on_poke` runs a calendar load; it returns an error text, or None when it worked.
    """

    def __init__(
        self,
        warehouse: Warehouse,
        registry: Registry,
        objects: Callable[[SourceSpec], DataFrame] | None = None,
        on_poke: Callable[[SourceSpec, str], str | None] | None = None,
        channel_token: str | None = None,
        name: str = "webhooks",
        now: Callable[[], datetime] = utc_now,
    ):
        session.prepare(warehouse.spark)
        self.warehouse = warehouse
        self.registry = registry
        self.objects = objects
        self.on_poke = on_poke
        self.channel_token = channel_token
        self.name = name
        self.now = now

    def accept(self, envelopes: DataFrame) -> DataFrame:
        """Envelopes that may be processed, with their key and the entity they are about."""
        rows = ops.parse_envelopes(envelopes)
        rows = ops.handshake_drop(ops.replay_window(rows), self.channel_token)
        own = [c for c in rows.columns if c != "attempt" and not c.startswith(("_", "landed_"))]
        attempt = F.col("attempt") if "attempt" in rows.columns else F.lit(1)
        payload = F.to_json(F.struct(*own))
        if landing.LINE in rows.columns:  # the call as it landed, fields that no schema names included
            payload = F.coalesce(landing.LINE, payload)
        return rows.select(
            *own,
            attempt.alias("attempt"),
            lookups.delivery_entity().alias("entity_type"),
            payload.alias("payload"),
        )

    def process(
        self, envelopes: DataFrame, batch_id: str, scratch: str | None = None
    ) -> DataFrame:
        """Process one micro-batch; returns every delivery with its outcome.

        The outcomes are read from the folder `scratch`, the caller's to remove.
        """
        w, now = self.warehouse, self.now()
        self._scratch = scratch or session.new_scratch(w.spark, "webhooks")
        accepted = self.accept(envelopes).withColumn("delivery_id", F.monotonically_increasing_id())
        accepted = self._stage(accepted, "deliveries")
        ledger = self._ledger(batch_id, accepted)
        states = self._settle(
            lookups.new_deliveries(accepted, ledger),
            lookups.known_deliveries(accepted, ledger),
            ledger, batch_id, now,
        )
        rows = ops.ledger_rows(states, ORDER, now)
        if not rows.isEmpty():
            w.webhook_events.commit(rows, now, batch_id=batch_id)
        return states.drop(*ABOUT)

    def _settle(
        self,
        fresh: DataFrame,
        known: DataFrame | None,
        ledger: DataFrame | None,
        batch_id: str,
        now: datetime,
        once: bool = False,
    ) -> DataFrame:
        """Judge deliveries, write what those that ran bring, and tell every one's outcome.

        `known` are the deliveries of keys that the ledger has as processed. Where each key
        comes `once` its attempts need no order: outcomes are told where the verdicts are, and
        only written out without the payloads.
        """
        w = self.warehouse
        verdicts = []
        if known is not None:
            verdicts.append(_verdict(known, F.lit(False), F.lit(None)))
        writes: list[tuple[SourceSpec, Callable[[DataFrame], DataFrame]]] = []
        configured = F.lit(False)
        for spec in self.registry.all():
            mine = (F.col("provider") == spec.provider) & (F.col("entity_type") == spec.entity_type)
            configured = configured | mine
            rows = fresh.where(mine)
            if spec.entity_type == vocab.PAYMENT:
                verdict, write = self._payments(spec, rows, once)
            elif spec.entity_type == vocab.EVENT:
                verdict, write = self._pokes(spec, rows, batch_id)
            else:
                verdict, write = self._notifications(spec, rows)
            verdicts.append(verdict)
            if write:
                writes.append((spec, write))
        # Event types that change no data, and sources nobody configured, are acknowledged.
        acknowledged = fresh.where(~F.coalesce(configured, F.lit(False)))
        verdicts.append(_verdict(acknowledged, F.lit(True), F.lit(None)))

        judged = verdicts[0]
        for v in verdicts[1:]:
            judged = judged.unionByName(v)
        told = ops.delivery_states(judged, ledger, ["delivery_id"] if once else ORDER, once)
        states = self._stage(told.drop("payload") if once else told, "delivery-states")

        ran = states.where(F.col("outcome") == vocab.PROCESSED)
        for spec, write in writes:
            self._upsert(spec, write(ran), batch_id, now)
        append_failures(w, lookups.unconfigured(ran, self.registry), f"unconfigured:{batch_id}")
        done = ran.where(F.col("fate") == OPEN) if once else None
        return (told, done) if once else states

    # ---- parts: each gives the deliveries' verdicts, and the rows to write for those that ran

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._scratch}/{name}-{uuid.uuid4().hex}"
        return session.stage_at(df, path, self.warehouse.spark)

    def _ledger(self, batch_id: str, accepted: DataFrame) -> DataFrame:
        """The ledger as it was before this batch, also when the batch is replayed; of it what
        the batch's keys can be in."""
        table = self.warehouse.webhook_events
        done = table.commits().where(F.col("batch_id") == batch_id).first()
        buckets = table.buckets_of(accepted)
        return table.read(version=done.version - 1 if done else None, buckets=buckets)

    def _payments(self, spec: SourceSpec, rows: DataFrame, once: bool):
        """Payment events carry the payment itself."""
        about = ["idempotency_key", "provider", "event_type", *[c for c in ABOUT if c in rows.columns]]
        carried = rows.withColumn("arrival_seq", F.struct(*ORDER, F.struct(*about).alias("about")))
        normal = normalize.normalize_payment_event(carried, self.warehouse.mapping, spec.provider)
        judged = self._stage(
            _judge(normal, spec.rules()).withColumn("delivery_id", F.col("arrival_seq.delivery_id")),
            "payment-events",
        )
        arrived = [F.col(f"arrival_seq.{c}") for c in ORDER]
        verdict = _verdict(
            judged.select("arrival_seq.about.*", *arrived, "process_ok", "error"),
            F.col("process_ok"),
            F.col("error"),
        )

        def write(ran: DataFrame) -> DataFrame:
            # Of a key that comes once every attempt that can be processed is.
            mine = judged.where("process_ok") if once else judged.join(
                ran.select("delivery_id"), "delivery_id", "left_semi"
            )
            return mine.withColumn("arrival_seq", F.struct(*arrived))

        return verdict, write

    def _notifications(self, spec: SourceSpec, rows: DataFrame):
        """Contacts and deals: the notification names an object, whose landed state is loaded."""
        if self.objects:
            latest = lookups.refetch_by_id(rows, self.objects(spec), spec.watermark(), ["updatedAt"])
        else:
            latest = objects.lookup(self.warehouse, spec, rows)
        judged = self._stage(
            _judge(normalized(spec, latest, self.warehouse.mapping), spec.rules()), "objects"
        )
        found = rows.join(
            judged.select(F.col("source_id").alias("object_id"), "process_ok", "error"),
            "object_id",
            "left",
        )
        missing = F.when(
            F.col("process_ok").isNull(), F.concat(F.lit("object not found: "), "object_id")
        )
        verdict = _verdict(found, F.col("process_ok"), F.coalesce("error", missing))

        def write(ran: DataFrame) -> DataFrame:
            mine = ran.where(
                (F.col("provider") == spec.provider) & (F.col("entity_type") == spec.entity_type)
            )
            ids = mine.select(F.col("object_id").alias("source_id")).distinct()
            return judged.join(ids, "source_id", "left_semi")

        return verdict, write

    def _pokes(self, spec: SourceSpec, rows: DataFrame, batch_id: str):
        """A poke carries nothing: one load serves all of a batch's, and they share its fate."""
        error = None
        if not rows.isEmpty():
            error = self.on_poke(spec, batch_id) if self.on_poke else "no calendar load configured"
        return _verdict(rows, F.lit(error is None), F.lit(error)), None

    def _upsert(self, spec: SourceSpec, rows: DataFrame, batch_id: str, now: datetime) -> None:
        if rows.isEmpty():
            return
        table = self.warehouse.tables[spec.entity_type]
        order = ["arrival_seq"] if "arrival_seq" in rows.columns else None
        commit = table.commit(
            normalize.stamp_synced_at(rows, now), now, batch_id=batch_id, order=order
        )
        self.warehouse.audit.append(
            upsert.audit_rows(table.changes(commit.version), spec.entity_type, batch_id, now),
            f"{spec.entity_type}:{batch_id}",
        )

    # ---- as a stream -------------------------------------------------------

    def _judged(self, accepted: DataFrame) -> DataFrame:
        """Attempts as the state takes them: key, `at`, and what is known of their fate.

        Whether a payment event can be processed shows in itself. What a notification or a
        poke stands for is only seen when the batch is settled: they are open till then.
        """
        mine, configured = F.lit(False), F.lit(False)
        for spec in self.registry.all():
            here = (F.col("provider") == spec.provider) & (F.col("entity_type") == spec.entity_type)
            configured = configured | here
            if spec.entity_type == vocab.PAYMENT:
                mine = mine | here
        mine, configured = (F.coalesce(c, F.lit(False)) for c in (mine, configured))
        attempt = ["received_at", "attempt", "payload"]
        others = accepted.where(~mine).select(
            "idempotency_key", *attempt, F.when(configured, OPEN).otherwise(OK).alias("fate")
        )
        rows = [others]
        for spec in self.registry.all():
            if spec.entity_type == vocab.PAYMENT:
                own = accepted.where((F.col("provider") == spec.provider) & (F.col("entity_type") == vocab.PAYMENT))
                carried = own.withColumn("arrival_seq", F.struct("idempotency_key", *attempt))
                normal = normalize.normalize_payment_event(carried, self.warehouse.mapping, spec.provider)
                ok = F.coalesce(validate.is_valid(spec.rules()), F.lit(False))
                rows.append(normal.select("arrival_seq.*", F.when(ok, OK).otherwise(FAILED).alias("fate")))
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out.withColumn("at", F.current_timestamp())

    def keyed_state(self, envelopes: DataFrame, processed: DataFrame) -> DataFrame:
        """The stream of keys that a micro-batch touches, each with the state it is left in.

        `won` is a key's first successful attempt and `last`, asked for while there is none,
        the latest of the others, by batch and then by arrival. `processed` brings keys that were processed without this stream's seeing
        it, with `at` from before any batch.
        """
        attempts = self._judged(self.accept(envelopes))
        known = processed.select("idempotency_key", "at", F.lit(OK).alias("fate"))
        rows = attempts.unionByName(known, allowMissingColumns=True)
        here = F.struct("at", "received_at", "attempt", "payload", "fate")
        seen = rows.groupBy("idempotency_key").agg(
            F.min(F.when(F.col("fate") == OK, here)).alias("won"),
            F.min("at").alias("first_at"),
            F.max(F.when(F.col("payload").isNotNull() & (F.col("fate") != OK), here)).alias("last"),
        )
        return seen.withColumn("now", F.current_timestamp())

    def _settle_touched(self, touched: DataFrame, envelope, batch_id: str, processed: str) -> None:
        """Settle the keys that a micro-batch brought something new for, by one attempt each."""
        w, now = self.warehouse, self.now()
        wins = F.col("won.at") == F.col("now")
        runs = wins | (F.col("won").isNull() & (F.col("last.at") == F.col("now")))
        decided = F.when(wins, F.col("won")).otherwise(F.col("last"))
        fresh = (
            touched.where(runs)
            .select("idempotency_key", decided.alias("_d"), (F.col("first_at") < F.col("now")).alias("seen_before"))
            .withColumn("_e", F.from_json("_d.payload", envelope))
            .select(
                *[F.col("_e")[c].alias(c) for c in envelope.names], "_d.attempt", "_d.payload", "_d.fate", "seen_before",
            )
        )
        fresh = (
            ops.parse_envelopes(fresh)
            .withColumn("entity_type", lookups.delivery_entity())
            .withColumn("delivery_id", F.monotonically_increasing_id())
        )
        fresh = self._stage(fresh, "fresh")
        states, done = self._settle(fresh, None, None, batch_id, now, once=True)
        rows = ops.ledger_rows(states, None, now, once=True).withColumn(
            "outcome", F.when(F.col("seen_before"), vocab.UPDATED).otherwise(vocab.CREATED)
        )
        if not fresh.isEmpty():
            w.webhook_events.commit(rows, now, batch_id=batch_id)
        # What was open became known here, which the state learns with the next batch.
        _write_processed(done, f"{processed}/batch={batch_id.rpartition(':')[2]}")

    def start(
        self, envelopes: DataFrame, checkpoint: str, every: str | None = None
    ) -> StreamingQuery:
        """Process a stream of envelopes, with the keys' state in the checkpoint.

        The state begins with what the ledger has as processed when the checkpoint is new,
        and has no end, as the ledger has none; it lies in RocksDB on the executors' disks.
        Where several micro-batches make up one `availableNow` run, a notification or poke
        that repeats an earlier one of that run is done again, which loads the same objects.
        """
        w = self.warehouse
        spark = w.spark
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        processed = f"{checkpoint.rstrip('/')}-processed"
        if not _exists(spark, f"{processed}/batch=start/_SUCCESS"):
            ledger = w.webhook_events.read().where(F.col("processing_status") == vocab.PROCESSED)
            _write_processed(ledger, f"{processed}/batch=start")
        marks = spark.readStream.schema(PROCESSED).option("pathGlobFilter", "*.parquet").parquet(processed)
        own = T.StructType([f for f in envelopes.schema.fields if f.name in schemas.ENVELOPE.names])
        state = self.keyed_state(envelopes, marks)

        def run(batch: DataFrame, batch_no: int) -> None:
            with session.scratch(spark, w.root) as path:
                self._scratch = path
                self._settle_touched(batch, own, f"{self.name}:{batch_no}", processed)

        writer = state.writeStream.outputMode("update").foreachBatch(run)
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _write_processed(rows: DataFrame, path: str) -> None:
    """Keys that are processed, as of before any batch to come."""
    at = F.timestamp_seconds(F.lit(0)).alias("at")
    rows.select("idempotency_key", at).write.mode("overwrite").parquet(path)


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
