"""All tables of one installation, under one root folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from revsync import schemas, vocab
from revsync.functions import times
from revsync.operators import upsert, validate
from revsync.plans.store import Log, Table
from revsync.sources import dims


class Warehouse:
    """The canonical tables, the ledger, the status mapping and the logs.

    `mapping` is what the status mapping starts from; edits to it are stored, and whoever
    asks next, a stream's next micro-batch in another session included, sees them.
    """

    def __init__(self, spark: SparkSession, root: str, mapping: DataFrame | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self._mapping = mapping if mapping is not None else dims.status_mapping_seed(spark)
        self.providers = dims.provider_dim(spark)
        self.mapping_edits = self._table(
            "payment_status_mappings", schemas.STATUS_MAPPINGS,
            keys=["provider", "raw_status"], updated="updated_at", buckets=1,
        )
        self.tables = {
            vocab.CONTACT: self._table("canonical_contacts", schemas.CONTACTS),
            vocab.DEAL: self._table("canonical_deals", schemas.DEALS),
            vocab.EVENT: self._table("canonical_events", schemas.EVENTS),
            vocab.PAYMENT: self._table(
                "canonical_payments", schemas.PAYMENTS, month_of="occurred_at"
            ),
        }
        self.objects = {
            entity: self._table(
                f"landed_objects/{entity}", schemas.LANDED_OBJECTS, updated="modified"
            )
            for entity in (vocab.CONTACT, vocab.DEAL)
        }
        self.webhook_events = self._table(
            "webhook_events",
            schemas.WEBHOOK_EVENTS,
            keys=["idempotency_key"],
            updated="processed_at",
        )
        self.jobs = self._log("job_history", schemas.JOB_HISTORY)
        self.failures = self._log("failure_logs", schemas.FAILURE_LOGS)
        self.audit = self._log("canonical_record_audit", schemas.AUDIT)

    def _table(self, name: str, schema, **kw) -> Table:
        rules = name if name in validate.TABLES else None
        return Table(self.spark, f"{self.root}/{name}", schema, name=rules, **kw)

    def _log(self, name: str, schema) -> Log:
        return Log(self.spark, f"{self.root}/{name}", schema, name if name in validate.TABLES else None)

    @property
    def mapping(self) -> DataFrame:
        """The status mapping as it is now; a word that is no status fails what uses it."""
        stored = self.mapping_edits.read().drop("updated_at")
        return dims.check_status_map(upsert.upsert_mapping(self._mapping, stored))

    def edit_mapping(self, edits: DataFrame, now: datetime) -> None:
        """Store rows of (provider, raw_status, canonical_status), in place of those they name."""
        checked = dims.check_status_map(validate.enforce(edits, "payment_status_mappings"))
        self.mapping_edits.commit(checked.withColumn("updated_at", times.at(now)), now)

    #: The canonical tables' names.
    names = {
        vocab.CONTACT: "canonical_contacts",
        vocab.DEAL: "canonical_deals",
        vocab.EVENT: "canonical_events",
        vocab.PAYMENT: "canonical_payments",
    }

    def register_views(self) -> None:
        """The canonical tables as temporary views, for SQL."""
        for entity, name in self.names.items():
            self.tables[entity].read().createOrReplaceTempView(name)
        self.webhook_events.read().createOrReplaceTempView("webhook_events")
        self.jobs.read().createOrReplaceTempView("job_history")
        self.failures.read().createOrReplaceTempView("failure_logs")
        self.audit.read().createOrReplaceTempView("canonical_record_audit")
