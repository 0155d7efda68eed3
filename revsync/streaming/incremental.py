"""A landing folder as a stream: the checkpoint takes the cursor's place."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from revsync import session
from revsync.plans.incremental import run_batch
from revsync.plans.warehouse import Warehouse
from revsync.sources.registry import SourceSpec


def utc_now() -> datetime:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def stream_incremental(
    warehouse: Warehouse,
    spec: SourceSpec,
    landed: DataFrame,
    checkpoint: str,
    name: str = "incremental",
    every: str | None = None,
    now: Callable[[], datetime] = utc_now,
    policy: str = "arrival",
) -> StreamingQuery:
    """Load what lands: everything there is and then stop, or `every` '15 minutes' for good.

    Every micro-batch is a run in the run log. One replayed after a crash carries the same id
    and is found committed.
    """

    session.prepare(warehouse.spark)

    def load(batch: DataFrame, batch_no: int) -> None:
        batch_id = f"{name}:{batch_no}"
        run_batch(warehouse, spec, batch, batch_id, now(), policy=policy)

    writer = landed.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
