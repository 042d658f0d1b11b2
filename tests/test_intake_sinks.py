"""Intake edge cases, webhooks, sinks and documents."""

import datetime as dt
import json

from pyspark.sql import functions as F

from paytrail.functions.money import line_cents
from paytrail.operators import events as E
from paytrail.operators import intake as I
from paytrail.sources import sinks as S

T = dt.datetime(2024, 6, 15, 9, 0)


def test_line_cents_truncation_and_exact(spark):
    df = spark.createDataFrame([(19.99, 1), (0.29, 1), (9.99, 0), (1.15, -3), (19.99, 3)], "price double, qty int")
    got = df.select(line_cents(F.col("price"), F.col("qty")).alias("p"),
                    line_cents(F.col("price"), F.col("qty"), "exact").alias("e")).collect()
    assert [r.p for r in got] == [1998, 28, 999, 114, 5996]  # (19.99*100)*3 = 5996.99..., truncated
    assert [r.e for r in got] == [1999, 29, 999, 115, 5997]


def test_validation_first_rule_wins(spark):
    rows = [(1, '{"customer_info":{"email":""},"items":[]}'),
            (2, '{"customer_info":{"email":"a@b"},"items":[]}'),
            (3, '{"customer_info":{"email":"a@b"},"items":[{"price":1.0,"quantity":1}]}'),
            (4, '{"customer_info":{"email":"a@b"},"items":[{"price":1.0,'),
            (5, '{"customer_info":{"email":"a@b"},"items":[{"price":"oops","quantity":1}]}')]
    v = {r.request_key: r for r in I.validate_order_requests(
        spark.createDataFrame(rows, "request_key long, payload string")).collect()}
    assert v[1].reason == "Customer email is required"
    assert v[2].reason == "At least one item is required"
    assert v[3].valid and v[3].reason is None
    assert v[4].reason == "Invalid request body"
    assert v[5].reason == "Invalid request body"  # type mismatch is rejected, as in Go


def test_webhook_size_cap_and_unreadable(spark):
    ok = json.dumps({"id": "evt_1", "type": "payment_intent.succeeded", "data": {"object": {"id": "pi_1"}}})
    big = json.dumps({"id": "evt_2", "type": "x", "data": {"object": {"id": "y", "d": "z" * 70000}}})
    rows = [(1, T, ok), (2, T, big), (3, T, ok[:-3])]
    w = {r.event_id: r for r in E.webhook_ingest(
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, payload string")).collect()}
    assert w[1].reject_reason is None and w[1].object_id == "pi_1"
    assert w[2].reject_reason == "payload_too_large"
    assert w[3].reject_reason == "unreadable_payload" and w[3].type is None


def test_upsert_rejects_and_latest_wins(spark):
    base = spark.createDataFrame([("a", "a@x", "created", T, T), ("b", "b@x", "paid", T, T)],
                                 "id string, customer_email string, status string, created_at timestamp_ntz, "
                                 "updated_at timestamp_ntz")
    t1, t2 = T + dt.timedelta(hours=1), T + dt.timedelta(hours=2)
    upd = spark.createDataFrame([("a", "new1@x", t1, 1), ("a", "new2@x", t2, 2), ("zz", "z@x", t1, 1)],
                                "id string, customer_email string, updated_at timestamp_ntz, seq long")
    ins = spark.createDataFrame([("", "e@x", "created", T, T, 0), ("b", "dup@x", "created", T, T, 0),
                                 ("c", "c@x", "created", T, T, 0)],
                                "id string, customer_email string, status string, created_at timestamp_ntz, "
                                "updated_at timestamp_ntz, seq long")
    snap, rej = S.order_upsert(base, upd, ins)
    s = {r.id: r for r in snap.collect()}
    assert s["a"].customer_email == "new2@x" and s["a"].updated_at == t2 and s["a"].change == "updated"
    # a whole row with a stored id replaces the stored row
    assert s["b"].change == "replaced" and s["b"].customer_email == "dup@x" and s["b"].status == "created"
    assert s["c"].change == "inserted" and len(s) == 3
    reasons = sorted((r.operation, r.reason) for r in rej.collect())
    assert reasons == [("insert", "order ID cannot be empty"), ("update", "order not found")]


def test_upsert_of_one_new_id_twice_keeps_the_latest(spark):
    base = spark.createDataFrame([("a", "a@x", T)], "id string, customer_email string, updated_at timestamp_ntz")
    ins = spark.createDataFrame([("n", "one@x", T, 1), ("n", "two@x", T, 2)],
                                "id string, customer_email string, updated_at timestamp_ntz, seq long")
    upd = spark.createDataFrame([("n", "three@x", T, 3)], "id string, customer_email string, updated_at timestamp_ntz, seq long")
    for u, want in ((upd.limit(0), "two@x"), (upd, "three@x")):
        snap, rej = S.order_upsert(base, u, ins)
        assert sorted((r.id, r.customer_email, r.change) for r in snap.collect()) == [("a", "a@x", "kept"), ("n", want, "inserted")]
        assert rej.count() == 0


def test_snapshot_pointer_swap(spark, tmp_path):
    from paytrail.session import scratch_path
    root = scratch_path(spark, "snap-test")
    S.write_snapshot(spark.range(3).toDF("id"), root)
    second = S.write_snapshot(spark.range(5).toDF("id"), root)
    assert S.read_snapshot(spark, root).count() == 5 and second.endswith(second.split("/")[-1])


def test_event_log_append_assigns_ids(spark):
    log = spark.createDataFrame([("evt_a", "o1", "order_created", "pending", "{}", T, 0)],
                                "id string, order_id string, event_type string, status string, data string, "
                                "created_at timestamp_ntz, seq long")
    new = spark.createDataFrame([("", "o2", "order_created", "pending", None, 0)],
                                "id string, order_id string, event_type string, status string, data string, seq long")
    out = {r.order_id: r for r in S.event_log_append(log, new, "2024-06-15 12:00:00").collect()}
    assert out["o2"].id.startswith("evt_") and len(out["o2"].id) == 28
    assert out["o2"].data == "{}" and out["o2"].created_at == dt.datetime(2024, 6, 15, 12)


def test_documents_omitempty_round_trip(spark, raw):
    from paytrail.operators import reports as R
    from paytrail.sources import fixtures as fx
    nested = R.assemble_orders(fx.model_orders(raw), fx.model_items(raw), fx.model_payments(raw))
    docs = S.order_documents(nested)
    rows = {r.id: json.loads(r.document) for r in docs.limit(200).collect()}
    for oid, d in rows.items():
        assert d["id"] == oid and "email" in d["customer_info"]
        assert "amount" in d["payment"] and "currency" in d["payment"]
        assert d["customer_info"].get("phone", "x") != ""
        assert ("fulfilled_at" in d) == (d["status"] == "fulfilled")
        assert all("download_url" not in i for i in d["items"])


def test_document_keys_and_times(spark, raw):
    from paytrail.operators import reports as R
    from paytrail.sources import fixtures as fx
    nested = R.assemble_orders(fx.model_orders(raw), fx.model_items(raw), fx.model_payments(raw))
    docs = [json.loads(r.document) for r in S.order_documents(nested).collect()]
    assert all(d["created_at"].endswith("Z") for d in docs)
    assert any("stripe_payment_intent_id" in d["payment"] for d in docs)
    one = spark.createDataFrame([(dt.datetime(2024, 6, 15, 9, 0, 0, 120000),), (dt.datetime(2024, 6, 15, 9, 0),)], "t timestamp_ntz")
    assert [r[0] for r in one.select(S.rfc3339(F.col("t"))).collect()] == ["2024-06-15T09:00:00.12Z", "2024-06-15T09:00:00Z"]
