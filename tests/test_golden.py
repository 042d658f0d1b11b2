"""Golden vectors taken from the reference's own tests and seed rows."""

import datetime as dt

from pyspark.sql import functions as F

from paytrail.operators import events as E
from paytrail.operators import intake as I
from paytrail.operators import reports as R
from paytrail.operators.fold import fold_order_state, guard_refunds
from paytrail.sources import sinks as S

NOW = "2024-06-15 12:00:00"
T = dt.datetime(2024, 6, 15, 9, 0)
ORDER_SCHEMA = ("id string, tracking_id string, customer_email string, customer_email_at_creation string, "
                "customer_name string, status string, created_at timestamp_ntz")
PAY_SCHEMA = "order_id string, payment_intent_id string, session_id string, amount long, currency string, status string"


def _orders(spark, rows):
    return spark.createDataFrame(rows, ORDER_SCHEMA)


def _payments(spark, rows):
    return spark.createDataFrame(rows, PAY_SCHEMA)


def test_stats_vector(spark):
    """3 orders (1000 paid, 2000 fulfilled, 1500 pending) -> total 3, completed 2,
    pending 1, revenue 30.0, average 15.0."""
    o = _orders(spark, [(f"order-{i}", f"TRK{i}", "a@b.c", "a@b.c", "A", s, T)
                        for i, s in ((1, "paid"), (2, "fulfilled"), (3, "pending"))])
    p = _payments(spark, [("order-1", "pi_1", None, 1000, "usd", "succeeded"),
                          ("order-2", "pi_2", None, 2000, "usd", "succeeded"),
                          ("order-3", "pi_3", None, 1500, "usd", "pending")])
    r = R.payment_stats_store(o, p, NOW).first()
    assert (r.total_orders, r.completed_orders, r.pending_orders) == (3, 2, 1)
    assert r.total_revenue == 30.0 and r.average_order_value == 15.0
    assert r.revenue_today == 30.0 and r.revenue_this_month == 30.0


def test_stats_midnight_and_future_rules(spark):
    """Q2: the store counts strictly after midnight and future orders; the view
    counts the calendar day."""
    midnight = dt.datetime(2024, 6, 15)
    future = dt.datetime(2024, 7, 2)
    o = _orders(spark, [("m", "T1", "e", "e", "n", "paid", midnight), ("f", "T2", "e", "e", "n", "paid", future)])
    p = _payments(spark, [("m", "pi_m", None, 100, "usd", "succeeded"), ("f", "pi_f", None, 200, "usd", "succeeded")])
    store = R.payment_stats_store(o, p, NOW).first()
    view = R.payment_stats_view(o, p, NOW).first()
    assert store.revenue_today == 2.0          # only the future order (strict >, no upper bound)
    assert view.revenue_today_cents == 100     # only the midnight order (same date)
    assert view.revenue_this_month_cents == 100 and store.revenue_this_month == 3.0


def test_no_orders_gives_zero_average(spark):
    o = _orders(spark, [("x", "T", "e", "e", "n", "pending", T)])
    p = _payments(spark, [("x", "pi", None, 500, "usd", "pending")])
    r = R.payment_stats_store(o, p, NOW).first()
    assert r.completed_orders == 0 and r.average_order_value == 0.0


def test_seed_rows_view(spark):
    """Commented seed rows: view total 2, completed 1, revenue 1499 cents."""
    o = _orders(spark, [("ord_sample_1", "TRK001", "test1@example.com", "test1@example.com", "Test Customer 1",
                         "created", T),
                        ("ord_sample_2", "TRK002", "test2@example.com", "test2@example.com", "Test Customer 2",
                         "paid", T)])
    p = _payments(spark, [("ord_sample_1", None, None, 999, "usd", "pending"),
                          ("ord_sample_2", None, None, 1499, "usd", "succeeded")])
    r = R.payment_stats_view(o, p, NOW).first()
    assert (r.total_orders, r.completed_orders, r.total_revenue_cents) == (2, 1, 1499)


def _request(spark, body):
    return spark.createDataFrame([(1, body)], "request_key long, payload string")


def test_full_flow_truncates_and_fulfils(spark):
    """19.99 x 1 -> 1998 cents (truncation); succeeded -> paid; fulfil -> fulfilled."""
    req = _request(spark, '{"customer_info":{"email":"flow@example.com","name":"F"},'
                          '"items":[{"product_id":"p1","product_name":"Guide","file_type":"PDF",'
                          '"price":19.99,"quantity":1}]}')
    a = I.accepted_orders(req).first()
    assert a.amount == 1998
    ops = spark.createDataFrame(
        [(a.order_id, T, 1, "succeeded", None), (a.order_id, T + dt.timedelta(hours=1), 2, "fulfill", None)],
        "order_id string, ts timestamp_ntz, event_id long, op string, set_intent string")
    known = spark.createDataFrame([(a.order_id, True)], "order_id string, intent_known boolean")
    s = fold_order_state(guard_refunds(ops, known)).state.first()
    assert s.order_status == "fulfilled" and s.payment_status == "succeeded"
    assert s.fulfilled_at == T + dt.timedelta(hours=1) and s.processed_at == T


def test_status_update_vector(spark):
    """Pending order, 1999 cents; payment -> succeeded => order paid."""
    ops = spark.createDataFrame([("o", T, 1, "succeeded", None)],
                                "order_id string, ts timestamp_ntz, event_id long, op string, set_intent string")
    known = spark.createDataFrame([("o", True)], "order_id string, intent_known boolean")
    s = fold_order_state(guard_refunds(ops, known)).state.first()
    assert (s.order_status, s.payment_status) == ("paid", "succeeded")


def test_tracking_vector(spark):
    """test-order-123 / TRK123456789, no events -> found, one row with no event."""
    o = _orders(spark, [("test-order-123", "TRK123456789", "t@e.com", "t@e.com", "T", "pending", T)])
    log = spark.createDataFrame([], "id string, order_id string, event_type string, status string, seq long")
    keys = spark.createDataFrame([("TRK123456789",), ("TRK-missing",)], "tracking_id string")
    rows = {r.tracking_id: r for r in R.track_payment(o, log, keys).collect()}
    assert rows["TRK123456789"].found and rows["TRK123456789"].event_id is None
    assert not rows["TRK-missing"].found


def test_bulk_inserts(spark):
    """1000 orders of 1000 cents with distinct ids -> 1000 rows, no rejects."""
    base = _orders(spark, []).select("id", "customer_email", "status", "created_at").withColumn(
        "updated_at", F.col("created_at"))
    ins = spark.range(1000).select(F.concat(F.lit("ORD"), F.col("id").cast("string")).alias("id"),
                                   F.lit("bulk@example.com").alias("customer_email"), F.lit("created").alias("status"),
                                   F.lit(T).cast("timestamp_ntz").alias("created_at"),
                                   F.lit(T).cast("timestamp_ntz").alias("updated_at"), F.col("id").alias("seq"))
    upd = spark.createDataFrame([], "id string, customer_email string, updated_at timestamp_ntz, seq long")
    snap, rej = S.order_upsert(base, upd, ins)
    assert snap.count() == 1000 and rej.count() == 0


def test_provider_status_map(spark):
    df = spark.createDataFrame([(s,) for s in ["succeeded", "canceled", "processing", "requires_payment_method",
                                               "requires_confirmation", "requires_action", "requires_capture", "x"]],
                               "s string")
    from paytrail.functions.status import map_provider_status
    got = [r[0] for r in df.select(map_provider_status(F.col("s"))).collect()]
    assert got == ["succeeded", "canceled", "pending", "pending", "pending", "pending", "failed", "failed"]
