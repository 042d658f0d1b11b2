"""Edge cases listed in SURVEY section 5.2."""

import datetime as dt
import json

from pyspark.sql import functions as F

from paytrail.operators import events as E
from paytrail.operators import reports as R

T = dt.datetime(2024, 6, 15, 9, 0)
ORDER_SCHEMA = ("id string, tracking_id string, customer_email string, customer_email_at_creation string, "
                "customer_name string, status string, created_at timestamp_ntz")
PAY_SCHEMA = "order_id string, payment_intent_id string, session_id string, amount long, currency string, status string"
ITEM_SCHEMA = "order_id string, line_no int, product_id string, price double, quantity int"


def _fixture(spark):
    orders = spark.createDataFrame(
        [(f"o{i}", f"T{i}", "e@x", "e@x", "n", "paid", T + dt.timedelta(hours=i)) for i in range(5)], ORDER_SCHEMA)
    payments = spark.createDataFrame([(f"o{i}", f"pi_{i}", f"cs_{i}" if i == 1 else None, 100 * i, "usd", "succeeded")
                                      for i in range(4)], PAY_SCHEMA)  # o4 has no payment
    orders = orders.withColumn("updated_at", F.col("created_at")).withColumn("fulfilled_at", F.lit(None).cast("timestamp_ntz"))
    payments = payments.withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    orders = orders.withColumn("customer_phone", F.lit(None).cast("string"))
    items = spark.createDataFrame([("o0", 1, "p", 1.0, 1), ("o0", 2, "p", 2.0, 0)], ITEM_SCHEMA)
    return orders, payments, items


def test_page_bounds(spark):
    o, p, i = _fixture(spark)
    assert R.orders_page(o, p, i, 2, 100).count() == 0                  # offset past the end
    assert R.orders_page(o, p, i, 0, 0).count() == 5                    # limit 0 -> default 50
    assert R.orders_page(o, p, i, "abc", "-1").count() == 5             # unparsable -> defaults
    ids = [r.id for r in R.orders_page(o, p, i, 2, 1).collect()]
    assert ids == ["o3", "o2"]                                          # newest first


def test_missing_payment_store_vs_view(spark):
    o, p, i = _fixture(spark)
    store = {r.id: r for r in R.order_summary_projection(o, p, i).collect()}
    view = {r.id: r for r in R.order_summaries_view(o, p, i).collect()}
    assert store["o4"].total_amount == 0.0 and view["o4"].amount is None   # Q8
    assert store["o0"].item_count == 2 and view["o3"].item_count == 0


def _payload(eid, typ, obj):
    return (eid, T + dt.timedelta(minutes=eid), json.dumps({"id": f"evt_{eid}", "type": typ, "data": {"object": obj}}))


def test_dead_letter_reasons(spark):
    o, p, _ = _fixture(spark)
    payloads = spark.createDataFrame([
        _payload(1, "customer.created", {"id": "cus_1"}),
        _payload(2, "payment_intent.succeeded", {"id": "pi_missing"}),
        _payload(3, "payment_intent.succeeded", {"id": "pi_2"}),
        _payload(4, "checkout.session.completed", {"id": "cs_nope", "payment_intent": "pi_3"}),
        _payload(5, "checkout.session.completed", {"id": "cs_1"}),
        (6, T, '{"id": "evt_6", "type": '),
    ], "event_id long, ts timestamp_ntz, payload string")
    commands = spark.createDataFrame([(7, T, "o_missing", "fulfill"), (8, T, "o0", "refund")],
                                     "event_id long, ts timestamp_ntz, order_id string, command string")
    b = E.EventBatch(payloads, commands, o, p, checkpoint=False)
    dead = {r.event_id: r.reason for r in b.dead_letter().collect()}
    assert dead == {1: "unhandled_event_type", 2: "order_not_found", 6: "unreadable_payload", 7: "order_not_found"}
    m = {r.event_id: (r.order_id, r.matched_by) for r in b.matched.collect()}
    assert m[3] == ("o2", "payment_intent")
    assert m[4] == ("o3", "payment_intent")       # session unknown -> intent fallback
    assert m[5] == ("o1", "session")


def test_horizon_limits_matching(spark):
    o, p, _ = _fixture(spark)
    payloads = spark.createDataFrame([_payload(1, "payment_intent.succeeded", {"id": "pi_0"}),
                                      _payload(2, "payment_intent.succeeded", {"id": "pi_3"})],
                                     "event_id long, ts timestamp_ntz, payload string")
    routed = E.route_webhooks(E.webhook_ingest(payloads))
    full = {r.event_id: r.order_id for r in E.events_to_orders_by_intent(routed, o, p).collect()}
    near = {r.event_id: r.order_id for r in E.events_to_orders_by_intent(routed, o, p, horizon=2).collect()}
    assert full == {1: "o0", 2: "o3"}
    assert near == {1: None, 2: "o3"}             # o0 is older than the newest 2 orders


def test_newest_order_wins_for_shared_intent(spark):
    o, _, _ = _fixture(spark)
    p = spark.createDataFrame([("o1", "pi_same", None, 1, "usd", "pending"), ("o3", "pi_same", None, 1, "usd", "pending"),
                               ("o2", "", None, 1, "usd", "pending")], PAY_SCHEMA)
    idx = {r.payment_intent_id: r.order_id for r in E.order_index(o, p, "payment_intent_id").collect()}
    assert idx == {"pi_same": "o3"}               # empty ids never match


def test_checkout_overwrite_rules(spark):
    o, p, _ = _fixture(spark)
    payloads = spark.createDataFrame([
        _payload(1, "checkout.session.completed",
                 {"id": "cs_1", "payment_intent": "pi_new", "customer_details": {"email": "a@x", "name": "Ann", "phone": ""}}),
        _payload(2, "checkout.session.completed",
                 {"id": "cs_1", "customer_details": {"email": "", "name": "", "phone": "555"}}),
    ], "event_id long, ts timestamp_ntz, payload string")
    b = E.EventBatch(payloads, spark.createDataFrame([], "event_id long, ts timestamp_ntz, order_id string, "
                                                       "command string"), o, p, checkpoint=False)
    r = E.apply_checkout_completed(b.matched, o, p).first()
    assert r.customer_email == ""                 # overwritten even by ""
    assert r.customer_name == "Ann"               # only non-empty names overwrite
    assert r.customer_phone == "555"
    assert r.payment_intent_id == "pi_new" and r.session_id == "cs_1"


def test_redelivered_webhook_dedup_option(spark):
    """Q6: a redelivered success moves a fulfilled order back to paid unless dedup=True."""
    o, p, _ = _fixture(spark)
    ok = {"id": "pi_1"}
    env = json.dumps({"id": "evt_same", "type": "payment_intent.succeeded", "data": {"object": ok}})
    payloads = spark.createDataFrame([(1, T, env), (3, T + dt.timedelta(hours=2), env)],
                                     "event_id long, ts timestamp_ntz, payload string")
    commands = spark.createDataFrame([(2, T + dt.timedelta(hours=1), "o1", "fulfill")],
                                     "event_id long, ts timestamp_ntz, order_id string, command string")
    plain = E.EventBatch(payloads, commands, o, p, checkpoint=False).fold.state.first()
    dedup = E.EventBatch(payloads, commands, o, p, dedup=True, checkpoint=False).fold.state.first()
    assert plain.order_status == "paid" and plain.fulfilled_at == T + dt.timedelta(hours=1)
    assert dedup.order_status == "fulfilled" and dedup.applied_events == 2


def test_hot_keys_stay_on_the_streamed_side(spark):
    """A customer with most orders and an order with a long history."""
    orders = spark.createDataFrame(
        [(f"h{i}", f"TH{i}", "hot@x", "hot@x", "n", "paid", T + dt.timedelta(minutes=i)) for i in range(400)]
        + [("c1", "TC1", "cold@x", "cold@x", "n", "paid", T)], ORDER_SCHEMA)
    emails = spark.createDataFrame([("hot@x",), ("cold@x",), ("none@x",)], "customer_email string")
    co = R.customer_orders(orders, emails)
    got = {}
    for r in co.collect():
        got.setdefault(r.customer_email, []).append(r)
    assert len(got["hot@x"]) == 400 and got["hot@x"][0].total_orders == 400
    assert got["hot@x"][0].order_id == "h399"                      # newest first
    assert got["none@x"][0].total_orders == 0 and got["none@x"][0].order_id is None
    log = spark.range(3000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"),
                                   F.lit("h7").alias("order_id"), F.lit("payment_failed").alias("event_type"),
                                   F.lit("failed").alias("status"), F.col("id").alias("seq"))
    keys = spark.createDataFrame([("TH7",), ("TC1",), ("T-none",)], "tracking_id string")
    tp = R.track_payment(orders, log, keys)
    rows = tp.collect()
    assert sum(r.tracking_id == "TH7" for r in rows) == 3000
    assert [r.found for r in rows if r.tracking_id == "T-none"] == [False]
    assert [r.event_id for r in rows if r.tracking_id == "TC1"] == [None]
    for df in (co, tp):
        assert "LeftOuter" not in df._jdf.queryExecution().executedPlan().toString()


def test_keyset_pages_equal_offset_pages(spark, raw):
    from paytrail.sources import fixtures as fx
    o, p, i = fx.model_orders(raw, with_customer=False), fx.model_payments(raw), fx.model_items(raw)
    cursor, seen = None, []
    for k in range(4):
        page = R.orders_page_after(o, p, i, *(cursor or (None, None)), limit=7).collect()
        assert [tuple(r) for r in page] == [tuple(r) for r in R.orders_page(o, p, i, 7, 7 * k).collect()]
        seen += [r.id for r in page]
        cursor = (page[-1].created_at, page[-1].id)
    assert len(set(seen)) == 28


def test_unhandled_intent_type_reported_once(spark):
    o, p, _ = _fixture(spark)
    payloads = spark.createDataFrame([_payload(1, "payment_intent.created", {"id": "pi_1"})],
                                     "event_id long, ts timestamp_ntz, payload string")
    commands = spark.createDataFrame([], "event_id long, ts timestamp_ntz, order_id string, command string")
    b = E.EventBatch(payloads, commands, o, p, checkpoint=False)
    assert [(r.event_id, r.reason) for r in b.dead_letter().collect()] == [(1, "unhandled_event_type")]
    assert b.fold.state.count() == 0


def test_fold_starts_from_the_stored_rows(spark):
    """A stored paid order is fulfilled by a command; times already stored stay."""
    o, p, _ = _fixture(spark)
    p = p.withColumn("processed_at", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    payloads = spark.createDataFrame([_payload(4, "payment_intent.succeeded", {"id": "pi_2"})], "event_id long, ts timestamp_ntz, payload string")
    commands = spark.createDataFrame([(1, T + dt.timedelta(days=1), "o1", "fulfill"), (2, T + dt.timedelta(days=2), "o1", "fulfill"),
                                      (3, T, "o4", "refund")],
                                     "event_id long, ts timestamp_ntz, order_id string, command string")
    b = E.EventBatch(payloads, commands, o, p, checkpoint=False)
    s = {r.order_id: r for r in b.fold.state.collect()}
    assert (s["o1"].order_status, s["o1"].payment_status, s["o1"].applied_events, s["o1"].rejected_fulfills) == ("fulfilled", "succeeded", 1, 1)
    assert s["o1"].fulfilled_at == T + dt.timedelta(days=1)
    assert s["o2"].processed_at == dt.datetime(2024, 6, 1)          # already processed: not set again
    assert (s["o4"].order_status, s["o4"].payment_status, s["o4"].rejected_refunds) == ("paid", "pending", 1)   # no payment row
    assert [r.event_type for r in b.event_log(include_created=False).filter("order_id = 'o1'").collect()] == ["order_fulfilled"]
