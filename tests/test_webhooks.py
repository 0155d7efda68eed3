"""Webhook deliveries: once with success, again after failure."""

import json
import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from revsync import schemas
from revsync.operators import deliveries, lookups
from revsync.plans.incremental import run_incremental
from revsync.plans.warehouse import Warehouse
from revsync.sources import landing, registry
from revsync.sources.registry import Registry
from revsync.streaming.webhooks import WebhookProcessor

NOW = at("2026-02-01T12:00")
DELIVERY = "idempotency_key string, provider string, attempt int, received_at timestamp_ntz, process_ok boolean"


def replay(data):
    """The attempts one by one, in order, as a receiver would meet them."""
    done, out, seen, count = set(), {}, set(), {}
    for key, _, attempt, received, ok in sorted(data, key=lambda d: (d[3], d[2])):
        prior = "processed" if key in done else "failed" if key in seen else None
        outcome = "duplicate_skipped" if key in done else "processed" if ok else "failed"
        seen.add(key)
        count[key] = count.get(key, 0) + 1
        if outcome == "processed":
            done.add(key)
        out[(key, attempt)] = (count[key], prior, outcome)
    return out


def test_against_one_by_one_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [
        ("hot" if i % 3 == 0 else f"k{rng.randrange(300)}", "stripe", i,
         at(f"2026-01-01T{rng.randrange(3):02d}:{rng.randrange(60):02d}:{rng.randrange(3):02d}"),
         rng.random() < (0.002 if i % 3 == 0 else 0.4))
        for i in range(3000)
    ]
    df = deliveries.delivery_sequence(spark.createDataFrame(data, DELIVERY))
    got = {
        (r.idempotency_key, r.attempt): (r.attempt_no, r.prior_status, r.outcome)
        for r in df.collect()
    }
    assert got == replay(data)


@pytest.mark.parametrize("operator", ["webhook_outcomes", "delivery_sequence"])
def test_a_hot_key_is_split_without_any_broadcast(spark, operator):
    """Half of all rows have one key: no task gets more than a few parts of it."""
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        data = spark.range(40_000).selectExpr(
            "if(id % 2 = 0, 'hot', concat('k', id)) idempotency_key", "'stripe' provider", "cast(id as int) attempt",
            "timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 5000) received_at", "id = 30000 process_ok",
        )
        made = getattr(deliveries, operator)(data)
        hot = made.withColumn("task", F.spark_partition_id()).where("idempotency_key = 'hot'").groupBy("task")
        counts = [r.n for r in hot.agg(F.count("*").alias("n"), F.max("outcome")).collect()]
        assert sum(counts) == 20_000 and len(counts) >= 12 and max(counts) < 4_000
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
        skipped = made.where("idempotency_key = 'hot' and outcome = 'duplicate_skipped'").count()
        position = [(i % 5000, i) for i in range(0, 40_000, 2)]
        assert skipped == sum(p > (30_000 % 5000, 30_000) for p in position)
    finally:
        for k in held:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ledger_status_counts(spark):
    data = [("a", "stripe", 1, NOW, True), ("b", "stripe", 1, NOW, True), ("c", "stripe", 1, NOW, False)]
    ledger = spark.createDataFrame(
        [("a", "processed"), ("b", "failed")], "idempotency_key string, processing_status string"
    )
    df = spark.createDataFrame(data, DELIVERY)
    got = rows(deliveries.delivery_states(df, ledger), "idempotency_key", "prior_status", "outcome")
    assert got == [
        ("a", "processed", "duplicate_skipped"), ("b", "failed", "processed"), ("c", None, "failed"),
    ]
    new = rows(lookups.new_deliveries(df, ledger), "idempotency_key")
    assert new == [("b",), ("c",)]


def envelope(**kw):
    out = dict.fromkeys(schemas.ENVELOPE.names)
    out.update(received_at="2026-01-31T00:00:00.000Z", event_created=1769817600, **kw)
    return out


def payment_event(event_id, status="succeeded", currency="usd", id="pi_1", **kw):
    obj = {"id": id, "created": 1767225600, "status": status, "amount": 500, "currency": currency}
    return envelope(
        provider="stripe", event_type=f"payment_intent.{status}", event_id=event_id,
        object=json.dumps(obj), **kw,
    )


def notice(event_id, type, object_id, sent="1769817600000"):
    return envelope(
        provider="hubspot", event_type=type, event_id=event_id, subscription_id="s",
        object_id=object_id, sent_at=sent,
    )


def poke(number, state="exists", token=None):
    return envelope(
        provider="google_calendar", event_type=state, channel_id="c", resource_id="r",
        message_number=number, resource_state=state, channel_token=token,
    )


@pytest.fixture
def w(spark, root):
    return Warehouse(spark, f"{root}/tables")


def processor(w, specs=(registry.PAYMENTS,), **kw):
    return WebhookProcessor(w, Registry(list(specs)), now=lambda: NOW, **kw)


def send(spark, p, batch_id, *envelopes):
    df = spark.createDataFrame([tuple(e.values()) for e in envelopes], schemas.ENVELOPE)
    return sorted(r.outcome for r in p.process(df, batch_id).collect())


def ledger(w):
    return rows(w.webhook_events.read(), "idempotency_key", "processing_status")


def payments(w):
    return rows(w.tables["payment"].read(), "source_id", "raw_status", "source_updated_at")


def test_first_then_again(spark, w):
    p = processor(w)
    assert send(spark, p, "q:0", payment_event("e1")) == ["processed"]
    assert payments(w) == [("pi_1", "succeeded", at("2026-01-31"))]
    # A restart, and the same delivery in a new batch.
    assert send(spark, processor(w), "q:1", payment_event("e1", "canceled")) == ["duplicate_skipped"]
    assert payments(w) == [("pi_1", "succeeded", at("2026-01-31"))]
    assert ledger(w) == [("stripe:e1", "processed")]


def test_failed_delivery_goes_again(spark, w):
    p = processor(w)
    assert send(spark, p, "q:0", payment_event("e1", currency="x")) == ["failed"]
    row = w.webhook_events.read().first()
    assert row.processing_status == "failed" and "ISO-4217" in row.error
    assert json.loads(row.payload)["event_id"] == "e1"
    assert send(spark, p, "q:1", payment_event("e1")) == ["processed"]
    assert send(spark, p, "q:2", payment_event("e1")) == ["duplicate_skipped"]
    assert ledger(w) == [("stripe:e1", "processed")] and len(payments(w)) == 1
    assert w.webhook_events.read().first().error is None


def test_replayed_batch_gives_the_same_and_writes_nothing(spark, w):
    p = processor(w)
    first = send(spark, p, "q:0", payment_event("e1"), payment_event("e2", "processing"))
    commits = (w.tables["payment"].commits().count(), w.webhook_events.commits().count())
    assert send(spark, p, "q:0", payment_event("e1"), payment_event("e2", "processing")) == first
    assert commits == (w.tables["payment"].commits().count(), w.webhook_events.commits().count())


def test_crash_between_the_tables_and_the_ledger(spark, w):
    """The payment was committed, the ledger not: the replay completes without doing it twice."""
    p, commit = processor(w), w.webhook_events.commit
    w.webhook_events.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(RuntimeError):
        send(spark, p, "q:0", payment_event("e1"))
    assert ledger(w) == [] and len(payments(w)) == 1
    w.webhook_events.commit = commit
    assert send(spark, p, "q:0", payment_event("e1")) == ["processed"]
    assert ledger(w) == [("stripe:e1", "processed")]
    assert w.tables["payment"].commits().count() == 1


def test_copies_inside_one_batch(spark, w):
    """Exact copies are one event; a third of the batch being one key changes nothing."""
    batch = [payment_event("e1")] * 4 + [payment_event(f"e{i}", id=f"pi_{i}") for i in range(2, 6)]
    got = send(spark, processor(w), "q:0", *batch)
    assert got.count("processed") == 5 and got.count("duplicate_skipped") == 3
    assert len(payments(w)) == 5


def test_other_events_are_acknowledged(spark, w):
    got = send(spark, processor(w), "q:0", envelope(provider="stripe", event_type="charge.x", event_id="9"))
    assert got == ["processed"] and ledger(w) == [("stripe:9", "processed")] and payments(w) == []


def test_source_that_is_not_configured(spark, w):
    got = send(spark, processor(w), "q:0", notice("1", "deal.creation", "77"), poke("1"))
    assert got == ["processed", "processed"]
    log = {r.entity_type: r for r in w.failures.read().collect()}
    assert {r.error_code for r in log.values()} == {"PROVIDER_NOT_CONFIGURED"}
    assert '"77"' in log["deal"].message and '"c:r"' in log["event"].message


def contacts(spark, *ids):
    data = [(i, (f"u{i}@x.yy",) + (None,) * 7, None, "2026-01-01T00:00:00Z") for i in ids]
    return spark.createDataFrame(data, schemas.CONTACT_OBJECT)


def test_notifications_bring_objects(spark, w):
    p = processor(w, [registry.CONTACTS], objects=lambda spec: contacts(spark, "1", "2", "3"))
    got = send(
        spark, p, "q:0",
        notice("1", "contact.creation", "1"), notice("2", "contact.propertyChange", "1"),
        notice("3", "contact.creation", "404"),
        notice("4", "contact.creation", "2", sent="1769000000000"),  # too old
    )
    assert got == ["failed", "processed", "processed"]
    assert rows(w.tables["contact"].read(), "source_id", "email") == [("1", "u1@x.yy")]
    errors = {r.idempotency_key: r.error for r in w.webhook_events.read().collect()}
    assert errors["hubspot:s:3"] == "object not found: 404"


def test_pokes_share_the_fate_of_their_load(spark, w):
    calls, fate = [], ["boom"]

    def load(spec, batch_id):
        calls.append(batch_id)
        return fate[0]

    p = processor(w, [registry.CALENDAR], on_poke=load, channel_token="t")
    batch = [poke("1", token="t"), poke("2", token="t"), poke("0", "sync", "t"), poke("3", token="z")]
    assert send(spark, p, "q:0", *batch) == ["failed", "failed"] and calls == ["q:0"]
    fate[0] = None
    assert send(spark, p, "q:1", poke("1", token="t")) == ["processed"]


def test_poke_runs_a_calendar_load(spark, w):
    event = ("e", "s", None, None, "confirmed", (None, "2026-01-01", None), (None, "2026-01-02", None),
             None, None, None, None, None, None, "2026-01-01T00:00:00Z")
    landed = spark.createDataFrame([event], schemas.CALENDAR_EVENT)
    p = processor(
        w, [registry.CALENDAR],
        on_poke=lambda spec, batch_id: run_incremental(w, spec, landed, NOW, batch_id).error,
    )
    assert send(spark, p, "q:0", poke("1")) == ["processed"]
    assert rows(w.tables["event"].read(), "source_id", "start_at") == [("e", at("2026-01-01"))]


def test_feed_as_a_stream_with_a_restart(spark, w, root):
    feed, checkpoint = f"{root}/feed", f"{root}/checkpoint"

    def land(*envelopes):
        lines = [(json.dumps(e),) for e in envelopes]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(feed)

    def go():
        stream = spark.readStream.schema(schemas.ENVELOPE).json(feed)
        processor(w).start(stream, checkpoint).awaitTermination()

    land(payment_event("e1"), payment_event("e2", currency="x", id="pi_2"))
    go()
    assert ledger(w) == [("stripe:e1", "processed"), ("stripe:e2", "failed")]
    land(payment_event("e1", "canceled"), payment_event("e2", id="pi_2"))
    go()
    assert ledger(w) == [("stripe:e1", "processed"), ("stripe:e2", "processed")]
    assert [p[:2] for p in payments(w)] == [("pi_1", "succeeded"), ("pi_2", "succeeded")]


class Feed:
    """A landing folder and a stream over it that is started anew each time."""

    def __init__(self, spark, root, make):
        self.spark, self.folder, self.checkpoint, self.make = spark, f"{root}/feed", f"{root}/checkpoint", make

    def send(self, *envelopes):
        lines = [(json.dumps(e),) for e in envelopes]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(self.folder)
        stream = self.spark.readStream.schema(schemas.ENVELOPE).json(self.folder)
        query = self.make().start(stream, self.checkpoint)
        query.awaitTermination()
        return query


def test_stream_keeps_keys_in_state_and_never_reads_the_ledger(spark, w, root):
    """What the ledger held before the stream began counts; after that only the state is asked."""
    send(spark, processor(w), "q:0", payment_event("e0", id="pi_0"), payment_event("e9", currency="x", id="pi_9"))
    reads, read = [], w.webhook_events.read
    w.webhook_events.read = lambda *a, **k: reads.append(1) or read(*a, **k)
    feed = Feed(spark, root, lambda: processor(w))
    hot = [payment_event("e1", currency="x")] * 300
    feed.send(payment_event("e0", "canceled", id="pi_0"), payment_event("e9", id="pi_9"), *hot)
    assert reads == [1]  # as the checkpoint was made
    assert dict(ledger_of(read)) == {"stripe:e0": "processed", "stripe:e9": "processed", "stripe:e1": "failed"}
    query = feed.send(payment_event("e1"))
    feed.send(payment_event("e1", "canceled"), payment_event("e0", "canceled", id="pi_0"))
    assert reads == [1]
    plan = query._jsq.explainInternal(True)
    assert "StateStoreSave" in plan and "webhook_events" not in plan
    # partial sums before the exchange: a key's attempts are combined where they are read
    assert plan.count("partial_min") >= 2 and "merge_min" in plan
    assert dict(ledger_of(read))["stripe:e1"] == "processed"
    assert {p[0]: p[1] for p in payments(w)} == {"pi_0": "succeeded", "pi_1": "succeeded", "pi_9": "succeeded"}


def ledger_of(read):
    return rows(read(), "idempotency_key", "processing_status")


def test_stream_learns_the_fate_of_notifications_and_pokes(spark, w, root):
    landed, fate, loads = ["1"], ["boom"], []

    def load(spec, batch_id):
        loads.append(batch_id)
        return fate[0]

    feed = Feed(
        spark, root,
        lambda: processor(w, [registry.CONTACTS, registry.CALENDAR], objects=lambda spec: contacts(spark, *landed), on_poke=load),
    )
    feed.send(notice("1", "contact.creation", "1"), notice("2", "contact.creation", "2"), poke("1"))
    first = {"hubspot:s:1": "processed", "hubspot:s:2": "failed", "google_calendar:c:r:1": "failed"}
    assert dict(ledger(w)) == first and len(loads) == 1
    landed.append("2")
    fate[0] = None
    again = [notice("1", "contact.creation", "1"), notice("2", "contact.creation", "2"), poke("1")]
    feed.send(*again)
    assert dict(ledger(w)) == dict.fromkeys(first, "processed") and len(loads) == 2
    commits = w.webhook_events.commits().count()
    feed.send(*again)
    assert len(loads) == 2 and w.webhook_events.commits().count() == commits
    assert rows(w.tables["contact"].read(), "source_id") == [("1",), ("2",)]


def test_stream_replays_a_batch_that_died_before_its_ledger(spark, w, root):
    feed = Feed(spark, root, lambda: processor(w))
    commit = w.webhook_events.commit
    w.webhook_events.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("driver lost"))
    with pytest.raises(Exception, match="driver lost"):
        feed.send(payment_event("e1"))
    assert ledger(w) == [] and len(payments(w)) == 1
    w.webhook_events.commit = commit
    feed.send(payment_event("e1", "canceled"), payment_event("e2", id="pi_2"))
    assert ledger(w) == [("stripe:e1", "processed"), ("stripe:e2", "processed")]
    assert [p[:2] for p in payments(w)] == [("pi_1", "succeeded"), ("pi_2", "succeeded")]
    assert w.tables["payment"].commits().count() == 2


def test_landed_calls_are_kept_whole(spark, w, root):
    """A field that no schema names is in the ledger's payload, as a batch and as a stream."""
    folder = f"{root}/calls"
    lines = [(json.dumps(payment_event("e1") | {"livemode": True}),)]
    spark.createDataFrame(lines, "value string").write.text(folder)
    processor(w).process(landing.read_landed(spark, folder, schemas.ENVELOPE), "q:0")
    assert json.loads(w.webhook_events.read().first().payload)["livemode"] is True
    lines = [(json.dumps(payment_event("e2", id="pi_2") | {"livemode": False}),)]
    spark.createDataFrame(lines, "value string").write.mode("append").text(folder)
    stream = landing.stream_landed(spark, folder, schemas.ENVELOPE)
    processor(w).start(stream, f"{root}/checkpoint").awaitTermination()
    payload = {r.idempotency_key: json.loads(r.payload) for r in w.webhook_events.read().collect()}
    assert payload["stripe:e2"]["livemode"] is False and len(payments(w)) == 2


def test_notified_objects_are_looked_up_by_their_folder(spark, w):
    """Loads keep the latest of each object; a lookup reads as many files however much has landed."""
    from revsync.plans import objects

    def land(batch, day, *ids):
        rows_ = [(i, (f"u{i}@{day}.yy",) + (None,) * 6 + (f"2026-01-{day:02d}T00:00:00Z",), None, None) for i in ids]
        objects.keep(w, registry.CONTACTS, spark.createDataFrame(rows_, schemas.CONTACT_OBJECT), batch, NOW)

    ids = [str(i) for i in range(60)]
    land("a", 5, *ids)
    land("b", 3, "1", "2")  # lands later, but is older
    land("c", 9, "2")
    p = processor(w, [registry.CONTACTS])
    got = send(spark, p, "q:0", notice("1", "contact.creation", "1"), notice("2", "contact.creation", "2"), notice("3", "contact.creation", "404"))
    assert got == ["failed", "processed", "processed"]
    assert rows(w.tables["contact"].read(), "source_id", "email") == [("1", "u1@5.yy"), ("2", "u2@9.yy")]
    table = w.objects["contact"]
    table.compact(NOW)
    one = spark.createDataFrame([("hubspot", "7")], "provider string, source_id string")

    def files():
        found = table.read(buckets=table.buckets_of(one))
        found.collect()
        return found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()

    assert files() == 1
    land("d", 10, *[str(i) for i in range(100, 400)])
    table.compact(NOW)
    assert files() == 1
