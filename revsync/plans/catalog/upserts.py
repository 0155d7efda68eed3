"""Upserts, cursors and the audit trail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from revsync import schemas, session
from revsync.functions import times
from revsync.operators import upsert
from revsync.plans import inputs
from revsync.plans.catalog.registry import CHECK_VIEWS, query
from revsync.plans.inputs import Inputs
from revsync.plans.store import Cursor, Log, Table
from revsync.sources import registry

NOW = datetime(2024, 2, 1, 12)
SMALL = schemas.struct(
    provider="string",
    source_id="string",
    amount_minor="bigint",
    source_updated_at="timestamp_ntz",
)

CHECK_VIEWS["batch_winners"] = """
select provider, source_id, amount_minor, source_updated_at
from (select *, row_number() over (partition by provider, source_id order by arrival_seq desc) as rn
  from {upsert_batch}) where rn = 1"""
CHECK_VIEWS["batch_outcomes"] = """
select b.*, t.source_id is not null as row_exists, t.source_updated_at as existing_updated_at,
  case when t.source_id is null then 'created'
    when t.source_updated_at = b.source_updated_at then 'unchanged' else 'updated' end as outcome
from {batch_winners} b left join {upsert_target} t using (provider, source_id)"""
CHECK_VIEWS["merged"] = """
select provider, source_id, amount_minor, source_updated_at from {batch_winners}
union all
select provider, source_id, amount_minor, source_updated_at from {upsert_target} t
where not exists (select 1 from {batch_winners} b
  where b.provider = t.provider and b.source_id = t.source_id)"""


def _batch(t: Inputs) -> DataFrame:
    return upsert.batch_last_write(t["upsert_batch"]).drop("arrival_seq")


@query("batch_last_write", "select * from {batch_winners}")
def batch_last_write(t: Inputs) -> DataFrame:
    return _batch(t)


@query(
    "upsert_lookup",
    "select provider, source_id, row_exists, existing_updated_at from {batch_outcomes}",
)
def upsert_lookup(t: Inputs) -> DataFrame:
    return upsert.upsert_lookup(_batch(t), t["upsert_target"]).select(
        *upsert.KEY, "row_exists", "existing_updated_at"
    )


@query("upsert_outcomes", "select provider, source_id, outcome from {batch_outcomes}")
def upsert_outcomes(t: Inputs) -> DataFrame:
    return upsert.upsert_outcomes(_batch(t), t["upsert_target"]).select(*upsert.KEY, "outcome")


@query(
    "upsert_summary",
    "select outcome, cast(count(*) as bigint) as rows from {batch_outcomes} group by 1",
)
def upsert_summary(t: Inputs) -> DataFrame:
    return upsert.upsert_summary(upsert.upsert_outcomes(_batch(t), t["upsert_target"]))


@query("upsert_snapshot", "select * from {merged}")
def upsert_snapshot(t: Inputs) -> DataFrame:
    return upsert.upsert_snapshot(t["upsert_target"], _batch(t))


@query(
    "upsert_snapshot_newest",
    """
select coalesce(b.provider, t.provider) as provider,
  coalesce(b.source_id, t.source_id) as source_id,
  case when b.source_id is not null
    and (t.source_id is null or b.source_updated_at >= t.source_updated_at)
    then b.amount_minor else t.amount_minor end as amount_minor,
  greatest(b.source_updated_at, t.source_updated_at) as source_updated_at
from {batch_winners} b full join {upsert_target} t
  on b.provider = t.provider and b.source_id = t.source_id""",
)
def upsert_snapshot_newest(t: Inputs) -> DataFrame:
    """The option that never lets an older row replace a newer one."""
    return upsert.upsert_snapshot(t["upsert_target"], _batch(t), policy="newest")


@query(
    "point_lookup",
    "select provider, source_id, amount_minor, source_updated_at from {upsert_target} t "
    "where exists (select 1 from {upsert_batch} b "
    "where b.provider = t.provider and b.source_id = t.source_id)",
)
def point_lookup(t: Inputs) -> DataFrame:
    return upsert.point_lookup(t["upsert_target"], t["upsert_batch"])


def _loaded_table(t: Inputs, compact: bool = False) -> Table:
    """The target committed as one batch and the batch as another."""
    table = Table(t.spark, session.new_scratch(t.spark, "upserts"), SMALL)
    table.commit(t["upsert_target"], NOW, batch_id="first")
    if compact:
        table.compact(NOW)
    cursor = Cursor("stripe", "payment", "1704067200", NOW)
    table.commit(
        t["upsert_batch"], NOW, cursor=cursor, batch_id="second", order=["arrival_seq"]
    )
    return table


@query("sink_canonical", "select * from {merged}")
def sink_canonical(t: Inputs) -> DataFrame:
    """Two commits to a table on disk, read back."""
    return _loaded_table(t, compact=True).read()


@query(
    "atomic_commit",
    """
select 1 as version, cast(count(*) as bigint) as created, cast(0 as bigint) as updated,
  cast(0 as bigint) as unchanged, cast(null as varchar) as token
from {upsert_target}
union all
select 2, cast(count(*) filter (where outcome = 'created') as bigint),
  cast(count(*) filter (where outcome = 'updated') as bigint),
  cast(count(*) filter (where outcome = 'unchanged') as bigint), '1704067200'
from {batch_outcomes}""",
)
def atomic_commit(t: Inputs) -> DataFrame:
    """The commit rows: counts and cursor of a batch become visible together."""
    return _loaded_table(t).commits().select("version", "created", "updated", "unchanged", "token")


@query(
    "sink_audit",
    """
select 'payment' as entity_type, provider, source_id, outcome as operation, 'job_1' as job_id,
  timestamp '2024-02-01 12:00:00' as occurred_at, cast(amount_minor as varchar) as snapshot_amount
from {batch_outcomes} where outcome in ('created', 'updated')""",
)
def sink_audit(t: Inputs) -> DataFrame:
    """Snapshots of what a batch created and updated, appended and read back."""
    rows = upsert.upsert_outcomes(_batch(t), t["upsert_target"])
    log = Log(t.spark, session.new_scratch(t.spark, "audit"), schemas.AUDIT)
    log.append(upsert.audit_rows(rows, "payment", "job_1", NOW))
    amount = F.get_json_object("snapshot", "$.amount_minor").alias("snapshot_amount")
    return log.read().select("*", amount).drop("snapshot")


@query(
    "cursor_upsert",
    """
select provider, entity_type, token, issued_at, expires_at from {issued_cursors}
union all
select provider, entity_type, token, issued_at, expires_at from {cursors} c
where not exists (select 1 from {issued_cursors} i
  where i.provider = c.provider and i.entity_type = c.entity_type)""",
)
def cursor_upsert(t: Inputs) -> DataFrame:
    return upsert.cursor_upsert(t["cursors"], t["issued_cursors"])


@query(
    "cursor_clear",
    "select provider, entity_type, token, issued_at, expires_at from {cursors} "
    "where expires_at is null",
)
def cursor_clear(t: Inputs) -> DataFrame:
    return upsert.cursor_clear(t["cursors"], t["cursors"].where("expires_at is not null"))


_WORDS = """
select provider, status as raw_status,
  case when count(*) % 2 = 0 then 'collected' else 'pending' end as canonical_status
from {raw_payments} group by 1, 2"""
CHECK_VIEWS["mapping_edits"] = _WORDS


@query(
    "mapping_upsert",
    """
select provider, raw_status, canonical_status from {mapping_edits}
union all
select provider, raw_status, canonical_status from {status_map} m
where not exists (select 1 from {mapping_edits} e
  where e.provider = m.provider and e.raw_status = m.raw_status)""",
)
def mapping_upsert(t: Inputs) -> DataFrame:
    """The mapping after an edit for every word the payments use."""
    edits = (
        t["raw_payments"]
        .groupBy("provider", F.col("status").alias("raw_status"))
        .agg(F.when(F.count(F.lit(1)) % 2 == 0, "collected").otherwise("pending")
             .alias("canonical_status"))
    )
    return upsert.upsert_mapping(t["status_map"], edits)


@query(
    "max_watermark",
    """
select 'contact' as entity_type, strftime(max(cast(left(lastmodifieddate, 23) as timestamp)),
  '%Y-%m-%dT%H:%M:%S.%gZ') as token from {raw_contacts}
union all
select 'deal', strftime(max(cast(left(hs_lastmodifieddate, 23) as timestamp)),
  '%Y-%m-%dT%H:%M:%S.%gZ') from {raw_deals}
union all
select 'event', strftime(max(updated), '%Y-%m-%dT%H:%M:%S.%gZ') from {raw_calendar}
union all
select 'payment', cast(greatest(cast(max(epoch(occurred_at)) as bigint), 1704067200) as varchar)
from {raw_payments}""",
)
def max_watermark(t: Inputs) -> DataFrame:
    """The next cursor of every source; payments never fall behind the prior one."""
    payloads = [
        (registry.CONTACTS, inputs.contact_payloads(t["raw_contacts"])),
        (registry.DEALS, inputs.deal_payloads(t["raw_deals"])),
        (registry.CALENDAR, inputs.calendar_payloads(t["raw_calendar"])),
        (registry.PAYMENTS, inputs.payment_payloads(t["raw_payments"])),
    ]
    out = None
    for spec, landed in payloads:
        tagged = landed.withColumn("entity_type", F.lit(spec.entity_type))
        prior = None
        if spec is registry.PAYMENTS:
            prior = t.spark.range(1).select(
                F.lit(spec.entity_type).alias("entity_type"),
                times.unix_ts(F.lit(1704067200)).alias("watermark"),
            )
        seen = upsert.max_watermark(tagged, spec.watermark(), ["entity_type"], prior)
        token = seen.select("entity_type", spec.token(F.col("watermark")).alias("token"))
        out = token if out is None else out.unionByName(token)
    return out


