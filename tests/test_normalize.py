"""Payloads as they land, JSON files included."""

import json

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from revsync import schemas, vocab
from revsync.operators import normalize, validate
from revsync.sources import dims, landing, registry


def land(spark, path, lines, schema):
    """JSON lines in a landing folder, read back."""
    texts = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode(
        "append"
    ).text(path)
    return landing.read_landed(spark, path, schema)


def contact(id="1", **properties):
    return {
        "id": id, "properties": properties,
        "createdAt": "2025-05-01T00:00:00Z", "updatedAt": "2025-05-02T00:00:00Z",
    }


def verdicts(df, spec):
    return {r.source_id: r.reject_message for r in validate.check(df, spec.rules()).collect()}


def test_contacts(spark, root):
    landed = land(
        spark, root,
        [
            contact("1", email="ada@example.com", firstname="Ada", createdate="2025-01-01T00:00:00Z",
                    lastmodifieddate="2026-01-01T00:00:00.500Z"),
            contact("2", email="not-an-email"),
            contact("3", email="", createdate=""),
            contact("", email="x@y.zz"),
            contact("5", createdate="someday"),
            "{broken",
        ],
        schemas.CONTACT_OBJECT,
    )
    df = normalize.normalize_contacts(landed)
    got = {r.source_id: r for r in df.collect()}
    assert got["1"].email == "ada@example.com" and got["1"].last_name is None
    assert got["1"].source_created_at == at("2025-01-01")
    assert got["1"].source_updated_at == at("2026-01-01T00:00:00.500")
    assert got["3"].email == "" and got["3"].source_created_at == at("2025-05-01")
    assert json.loads(got["1"].raw)["firstname"] == "Ada" and json.loads(got["1"].raw)["id"] == "1"
    assert verdicts(df, registry.CONTACTS) == {
        "1": None,
        "2": "Validation failed: email: email is not a valid address",
        "3": None,
        "": "Validation failed: sourceId: sourceId is required",
        "5": "createdate is not a valid date: someday",
        None: "payload is not valid JSON",
    }


def test_deals(spark, root):
    landed = land(
        spark, root,
        [
            contact("1", dealname="Big", amount="1500.50", dealstage="closedwon"),
            contact("2", amount=None),
            contact("3", amount=""),
            contact("4", amount="n/a"),
            contact("5", amount="-5"),
            contact("", amount="1"),
            contact("7", closedate="never"),
        ],
        schemas.DEAL_OBJECT,
    )
    df = normalize.normalize_deals(landed)
    got = {r.source_id: r for r in df.collect()}
    assert (got["1"].amount_minor, got["1"].currency) == (150050, "USD")
    assert (got["2"].amount_minor, got["2"].currency) == (None, None)
    assert (got["2"].deal_name, got["2"].stage) == ("(untitled deal)", "unknown")
    assert got["1"].primary_contact_source_id is None
    bad = verdicts(df, registry.DEALS)
    assert bad["1"] is bad["2"] is bad["3"] is None
    assert bad["4"] == "Money.amountMinor must be an integer, got NaN"
    assert bad["5"] == "Money.amountMinor must be >= 0, got -500"
    assert bad[""] == "Validation failed: sourceId: sourceId is required"
    assert bad["7"] == "closedate is not a valid date: never"


def test_calendar(spark, root):
    landed = land(
        spark, root,
        [
            {"id": "timed", "summary": "Call", "status": "confirmed",
             "start": {"dateTime": "2026-01-01T10:00:00+02:00", "timeZone": "Europe/Berlin"},
             "end": {"dateTime": "2026-01-01T11:00:00+02:00"},
             "organizer": {"email": "o@example.com"},
             "attendees": [{"email": "a@example.com", "responseStatus": "accepted"}, {}],
             "recurrence": ["RRULE:FREQ=DAILY"], "updated": "2026-01-02T00:00:00Z"},
            {"id": "allday", "start": {"date": "2026-01-05"}, "end": {"date": "2026-01-06"}},
            {"id": "tombstone", "status": "cancelled", "recurringEventId": "series",
             "originalStartTime": {"dateTime": "2026-01-03T09:00:00Z"}},
            {"id": "none"},
            {"id": "blocked", "start": {}, "originalStartTime": {"dateTime": "2026-01-03T09:00:00Z"}},
            {"id": "backwards", "start": {"date": "2026-01-05"}, "end": {"date": "2026-01-04"}},
            {"id": "odd", "status": "needsAction", "start": {"date": "2026-01-05"}},
            {"start": {"date": "2026-01-05"}},
        ],
        schemas.CALENDAR_EVENT,
    )
    df = normalize.normalize_calendar(landed)
    got = {r.source_id: r for r in df.collect()}
    timed = got["timed"]
    assert (timed.start_at, timed.end_at) == (at("2026-01-01T08:00"), at("2026-01-01T09:00"))
    assert (timed.timezone, timed.is_recurring) == ("Europe/Berlin", True)
    assert [tuple(a) for a in timed.attendees] == [("a@example.com", "accepted"), ("", None)]
    assert got["allday"].title == "(no title)" and got["allday"].status == "confirmed"
    assert got["allday"].attendees == [] and got["allday"].is_recurring is False
    assert got["tombstone"].start_at == got["tombstone"].end_at == at("2026-01-03T09:00")
    assert got["tombstone"].timezone is None and got["tombstone"].is_recurring is True
    # An empty start wins over the original one; its end falls back all the same.
    assert got["blocked"].start_at == at("1970-01-01")
    assert got["blocked"].end_at == at("2026-01-03T09:00")
    bad = verdicts(df, registry.CALENDAR)
    assert bad["timed"] is bad["allday"] is bad["tombstone"] is bad["blocked"] is None
    assert bad["none"] == (
        "Validation failed: start: event has no usable start/end/originalStartTime"
    )
    assert bad["backwards"] == "Validation failed: end: end must not be before start"
    assert bad["odd"] == 'Validation failed: status: unrecognized event status "needsAction"'
    assert bad[""] == "Validation failed: sourceId: sourceId is required"


def intent(id="pi_1", **kw):
    return {"id": id, "created": 1767225600, "status": "succeeded", "amount": 500,
            "currency": "usd", **kw}


def test_payments(spark, root):
    landed = land(
        spark, root,
        [
            intent("pi_1", customer="cus_1", description="d"),
            intent("pi_2", customer={"id": "cus_2", "object": "customer"}),
            intent("pi_3", status="odd"),
            intent("pi_4", amount=-1),
            intent("pi_5", currency="dollars"),
            intent("", amount=1),
        ],
        schemas.PAYMENT_INTENT,
    )
    df = normalize.normalize_payments(landed, dims.status_mapping_seed(spark))
    got = {r.source_id: r for r in df.collect()}
    one = got["pi_1"]
    assert (one.amount_minor, one.currency, one.customer_ref) == (500, "USD", "cus_1")
    assert one.occurred_at == one.source_created_at == one.source_updated_at == at("2026-01-01")
    assert (one.raw_status, one.canonical_status) == ("succeeded", "collected")
    assert got["pi_2"].customer_ref == "cus_2"
    assert (got["pi_3"].raw_status, got["pi_3"].canonical_status) == ("odd", "unknown")
    bad = verdicts(df, registry.PAYMENTS)
    assert bad["pi_1"] is bad["pi_2"] is bad["pi_3"] is None
    assert "got -1" in bad["pi_4"] and '"dollars"' in bad["pi_5"] and "sourceId" in bad[""]


def test_rejects_do_not_stop_the_rest(spark, root):
    landed = land(
        spark, root, [contact("1"), contact("2", email="bad"), contact("", email="bad")],
        schemas.CONTACT_OBJECT,
    )
    valid, rejects = validate.split_valid_rejects(
        normalize.normalize_contacts(landed), registry.CONTACTS.rules()
    )
    assert [r.source_id for r in valid.collect()] == ["1"]
    log = validate.failure_rows(rejects, "contact", "job", at("2026-01-01"))
    got = {json.loads(r.context).get("sourceId"): r for r in log.collect()}
    assert got["2"].error_code == "MALFORMED_RESPONSE"
    assert got[""].message == (
        "Validation failed: sourceId: sourceId is required; email: email is not a valid address"
    )
    issues = json.loads(got[""].context)["issues"]
    assert [i["field"] for i in issues] == ["sourceId", "email"]


def test_columns_that_nobody_asks_for_are_not_read(spark, root):
    rows_ = [("1", ("a@b.cc", "n") + (None,) * 6, None, None)]
    df = spark.createDataFrame(rows_, schemas.CONTACT_OBJECT)
    df.write.parquet(root)
    landed = landing.read_landed(spark, root, schemas.CONTACT_OBJECT, "parquet")
    plan = (
        normalize.normalize_contacts(landed).select("source_id", "email")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "ReadSchema: struct<id:string,properties:struct<email:string>" in plan


def test_unknown_kind_fails_the_job(spark):
    df = spark.createDataFrame([("contact", 1), ("invoice", 2)], "kind string, n int")
    with pytest.raises(Exception, match="unhandled record kind: invoice"):
        normalize.route_kinds(df)["contact"].collect()


def test_one_write_time_per_batch(spark):
    df = normalize.stamp_synced_at(spark.range(100), at("2026-01-01T10:00"))
    assert rows(df.select("synced_at").distinct()) == [(at("2026-01-01T10:00"),)]


def test_check_rules_cover_every_name(spark):
    tables = [
        "providers", "canonical_deals", "canonical_events", "canonical_payments", "sync_metadata",
        "job_history", "webhook_events", "payment_status_mappings", "canonical_record_audit",
    ]
    names = [name for t in tables for name, _ in validate.check_rules(t)]
    assert sorted(names) == sorted(vocab.CHECK_RULES)


def test_quarantine(spark):
    df = spark.createDataFrame(
        [(1, 5, "collected", "USD"), (2, -1, "settled", "usd"), (3, None, None, None)],
        "id int, amount_minor bigint, canonical_status string, currency string",
    )
    kept, out = validate.quarantine(df, "canonical_payments")
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 3]
    assert out.first().violations == (
        "payment_amount_non_negative,payment_canonical_status_valid,payment_currency_iso4217_format"
    )


def test_parse_landed_keeps_unreadable_lines(spark):
    df = spark.createDataFrame([(1, '{"id": "a"}'), (2, "{oops")], "n int, value string")
    parsed = landing.parse_landed(df, "value", schemas.CONTACT_OBJECT)
    got = {r.n: (r.id, r[landing.CORRUPT]) for r in parsed.collect()}
    assert got == {1: ("a", None), 2: (None, "{oops")}


def test_registry():
    r = registry.default_registry()
    with pytest.raises(ValueError):
        r.register(registry.CONTACTS)
    assert r.get("hubspot", "deal") is registry.DEALS and r.get("stripe", "deal") is None
    assert [s.entity_type for s in r.select("hubspot")] == ["contact", "deal"]
    with pytest.raises(ValueError):
        r.select("stripe", "deal")


def test_routing_words(spark):
    from revsync.operators import filters

    types = ["payment_intent.succeeded", "payment_intentx", "contact.creation", "deal.x", "charge.y"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(types)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(filters.event_entity(F.col("v"))).collect()]
    assert got == ["payment", None, "contact", "deal", None]


def test_landed_fields_outside_the_schema_are_kept(spark, root):
    """The stored payload is the landed one, whole."""
    line = '{"id": "pi_1", "created": 5, "status": "paid", "amount": 1, "currency": "usd", "metadata": {"a": [1]}}'
    spark.createDataFrame([(line,), ("",), ("{broken",)], "value string").write.text(f"{root}/in")
    landed = landing.read_landed(spark, f"{root}/in", schemas.PAYMENT_INTENT)
    assert landed.where("id is null").select("_corrupt_record", "landed_line").collect() == [("{broken",) * 2]
    got = normalize.normalize_payments(landed.where("id is not null"), dims.status_mapping_seed(spark))
    assert got.first().raw == line
    contact = {"id": "7", "properties": {"email": "a@b.cd", "custom": "x", "id": "no"}, "createdAt": "2025-01-01T00:00:00Z"}
    landed = land(spark, f"{root}/contacts", [contact], schemas.CONTACT_OBJECT)
    raw = normalize.normalize_contacts(landed).first().raw
    assert json.loads(raw) == {"email": "a@b.cd", "custom": "x", "id": "7"}


def test_parquet_payloads_are_kept_whole(spark, root):
    """Fields that no schema names, at the top and inside, are in `raw`; a query without it reads none of them."""
    import json

    spark.sql(
        "select '1' id, named_struct('email', 'a@b.cd', 'pet', 'cat') properties, 7 score, "
        "'2026-01-01T00:00:00Z' updatedAt"
    ).write.parquet(f"{root}/in")
    spark.sql("select '2' id, named_struct('email', 'b@b.cd') properties, 'x' other").write.mode("append").parquet(f"{root}/in")
    landed = landing.read_landed(spark, f"{root}/in", schemas.CONTACT_OBJECT, "parquet")
    got = {r.source_id: r for r in normalize.normalize_contacts(landed).collect()}
    assert (got["1"].email, got["1"].phone) == ("a@b.cd", None) and got["2"].email == "b@b.cd"
    assert json.loads(got["1"].raw)["pet"] == "cat"
    whole = {r.id: json.loads(r.landed_line) for r in landed.collect()}
    assert whole["1"]["score"] == 7 and whole["2"]["other"] == "x"
    plan = normalize.normalize_contacts(landed).select("email")._jdf.queryExecution().executedPlan().toString()
    assert "pet" not in plan.split("ReadSchema:")[1] and "score" not in plan.split("ReadSchema:")[1]


def test_parquet_payments_and_events_keep_their_types(spark, root):
    spark.sql(
        "select 'p' id, 1767225600 created, 'succeeded' status, 5 amount, 'usd' currency, "
        "named_struct('id', 'cus_1') customer, 1 extra"
    ).write.parquet(f"{root}/payments")
    landed = landing.read_landed(spark, f"{root}/payments", schemas.PAYMENT_INTENT, "parquet")
    row = normalize.normalize_payments(landed, dims.status_mapping_seed(spark)).first()
    assert (row.amount_minor, row.customer_ref, row.canonical_status) == (5, "cus_1", "collected")
    assert '"extra":1' in row.raw
    spark.sql(
        "select 'e' id, named_struct('date', '2026-01-02', 'kind', 'day') start, "
        "array(named_struct('email', 'a@b.cd', 'self', true)) attendees"
    ).write.parquet(f"{root}/events")
    landed = landing.read_landed(spark, f"{root}/events", schemas.CALENDAR_EVENT, "parquet")
    row = normalize.normalize_calendar(landed).first()
    assert row.attendees[0].email == "a@b.cd" and row.start_at.isoformat() == "2026-01-02T00:00:00"
    assert '"self":true' in row.raw
