"""What the webhook stream carries from step to step."""

from pyspark.sql import functions as F
from test_webhooks import NOW, payment_event, processor, w  # noqa: F401

from revsync import schemas
from revsync.operators import deliveries
from revsync.plans import store
from revsync.plans.inputs import Inputs
from revsync.streaming import webhooks


def test_state_holds_a_payload_once(spark, w):  # noqa: F811
    calls = [
        payment_event("won"), payment_event("lost", currency="us"),
        payment_event("late", currency="us"), payment_event("late"),
    ]
    envelopes = spark.createDataFrame(calls, schemas.ENVELOPE)
    known = spark.createDataFrame([], webhooks.PROCESSED)
    state = processor(w).keyed_state(envelopes, known)
    state = state.select("idempotency_key", F.col("won").isNotNull(), F.col("last.fate"))
    assert {tuple(r) for r in state.collect()} == {
        ("stripe:won", True, None), ("stripe:lost", False, "failed"), ("stripe:late", True, "failed"),
    }


def test_payloads_travel_in_few_staged_steps(spark, w, root, monkeypatch):  # noqa: F811
    spark.createDataFrame([payment_event("a"), payment_event("b", id="pi_2")], schemas.ENVELOPE).write.json(f"{root}/feed")
    staged, write = {}, webhooks.session.stage_at

    def stage_at(df, path, spark=None):
        out = write(df, path, spark)
        name = path.rsplit("/", 1)[1][:-33]
        staged[name] = "payload" in df.columns and not out.where("payload is not null").isEmpty()
        return out

    monkeypatch.setattr(webhooks.session, "stage_at", stage_at)
    feed = spark.readStream.schema(schemas.ENVELOPE).json(f"{root}/feed")
    processor(w).start(feed, f"{root}/checkpoint").awaitTermination()
    assert "touched" not in staged and staged["fresh"] and not staged["delivery-states"]
    assert w.webhook_events.read().where("payload is null").isEmpty()


def test_outcomes_of_keys_that_come_once_are_told_without_a_shuffle(spark):
    rows = spark.range(4).selectExpr(
        "concat('k', id) idempotency_key", "'stripe' provider", "'t' event_type", "timestamp_ntz'2026-01-01' received_at",
        "1 attempt", "'{}' payload", "id delivery_id", "id % 2 = 0 process_ok", "string(null) error",
    )
    ledger = spark.createDataFrame(
        [("k0", "processed"), ("k2", "failed")], "idempotency_key string, processing_status string"
    )
    told = deliveries.delivery_states(rows, None, ["delivery_id"], once=True)
    led = deliveries.ledger_rows(told, None, NOW, once=True)
    assert "Exchange" not in led._jdf.queryExecution().executedPlan().toString()
    for known in (None, ledger):
        told = deliveries.delivery_states(rows, known, ["delivery_id"], once=True)
        plain = deliveries.delivery_states(rows, known, webhooks.ORDER)
        assert told.exceptAll(plain).isEmpty() and plain.exceptAll(told).isEmpty()
        plain = deliveries.ledger_rows(plain, webhooks.ORDER, NOW)
        led = deliveries.ledger_rows(told, None, NOW, once=True).select(*plain.columns)
        assert led.exceptAll(plain).isEmpty() and plain.exceptAll(led).isEmpty()


def test_a_load_finds_its_folders_by_the_keys_of_its_batch_only(spark, w, monkeypatch):  # noqa: F811
    asked, find = [], store.Table.buckets_of
    monkeypatch.setattr(store.Table, "buckets_of", lambda t, rows: asked.append(rows) or find(t, rows))
    rows = spark.createDataFrame([("p", "1", NOW, "{}"), ("p", "1", NOW, "{ }")], schemas.LANDED_OBJECTS)
    table = w.objects["contact"]
    assert table.commit(rows, NOW, order=["modified", "payload"]).created == 1 and not asked
    assert table.commit(rows, NOW, order=["modified", "payload"]).unchanged == 1
    assert [a.columns for a in asked] == [table.keys]
    assert "Window" not in asked[0]._jdf.queryExecution().executedPlan().toString()
    assert table.read().count() == 1


def test_rows_of_one_row_group_are_dealt_to_several_tasks(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    dealt, plain = t.dealt("raw_calendar", "events", "event_id"), t["raw_calendar"]
    tasks = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= 8 and max(tasks) < plain.count() / 4
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
