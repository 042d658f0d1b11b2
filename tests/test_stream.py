"""The streaming queries against the batch operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paytrail.operators import events as E
from paytrail.operators.events import EventBatch
from paytrail.operators.fold import STATE_COLUMNS
from paytrail.session import scratch_path
from paytrail.sources import fixtures as fx
from paytrail.streaming import webhooks as W

T0 = dt.datetime(2024, 6, 15, 9, 0)
ORDER = "id string, customer_email string, customer_name string, customer_phone string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, fulfilled_at timestamp_ntz"
PAYMENT = "order_id string, payment_intent_id string, session_id string, status string, processed_at timestamp_ntz"
DELIVERY = "event_id bigint, ts timestamp_ntz, payload string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def webhook(eid, typ, obj, envelope=None, at=None):
    return (eid, at or T0 + dt.timedelta(minutes=eid), json.dumps({"id": envelope or f"evt_{eid}", "type": typ, "data": {"object": obj}}))


def small(spark, root, **settings):
    orders = spark.createDataFrame([("o1", "a@x", "Ann", None, "pending", T0, T0, None), ("o2", "z@x", None, None, "pending", T0, T0, None)], ORDER)
    payments = spark.createDataFrame([("o1", "pi_old", "cs_1", "pending", None), ("o2", None, None, "pending", None)], PAYMENT)
    return W.OrderStream(orders, payments, f"{root}/in", f"{root}/told", f"{root}/out", partitions=2, **settings)


def deliver(spark, stream, webhooks, commands=()):
    W.delivery_lines(spark.createDataFrame(webhooks, DELIVERY)).write.mode("append").text(stream.deliveries)
    spark.createDataFrame(list(commands), W.COMMANDS).write.mode("append").parquet(stream.commands_path)
    stream.run_available()


def test_stream_equals_batch_across_restarts_and_segments(spark, raw):
    """Slices of a feed, each processed by a new object on the same checkpoints (a restart), in segments of six hours."""
    orders, payments = fx.model_orders(raw), fx.model_payments(raw)
    payloads, commands = fx.webhook_payloads(raw), fx.model_commands(raw)
    root = scratch_path(spark, "stream-test")
    for arrived, told in W.slices(3, payloads, commands):
        stream = W.OrderStream(orders, payments, f"{root}/in", f"{root}/told", f"{root}/out", segment_seconds=21_600, partitions=3)
        W.delivery_lines(arrived).write.mode("append").text(stream.deliveries)
        told.write.mode("append").parquet(stream.commands_path)
        stream.run_available()
    batch = EventBatch(payloads, commands, orders, payments)
    assert rows(stream.state()) == rows(batch.fold.state.select(*STATE_COLUMNS))
    assert rows(stream.event_log()) == rows(batch.event_log(include_created=False))
    assert rows(stream.dead_letter()) == rows(batch.dead_letter())
    want = batch.checkouts().drop("n_checkouts")
    assert rows(stream.checkouts().select(*want.columns)) == rows(want)
    # the state is in Spark's store, several segments an order
    assert stream.summaries().count() > stream.state().count()
    # nothing new: another run changes nothing
    before = rows(stream.state())
    stream.run_available()
    assert rows(stream.state()) == before


def test_checkout_repoints_the_intent_for_later_batches(spark):
    """The first checkout writes a new intent id and customer; later webhooks for it find the order, those for the old id don't."""
    s = small(spark, scratch_path(spark, "checkout-test"))
    deliver(spark, s, [webhook(1, "checkout.session.completed", {"id": "cs_1", "payment_intent": "pi_new", "customer_details": {"email": "b@x", "name": "", "phone": "5"}})])
    deliver(spark, s, [webhook(2, "payment_intent.succeeded", {"id": "pi_new"}), webhook(3, "payment_intent.payment_failed", {"id": "pi_old"})])
    deliver(spark, s, [webhook(4, "checkout.session.completed", {"id": "cs_1", "customer_details": {"email": "c@x", "name": "Cy", "phone": ""}})])
    (state,) = s.state().collect()
    assert (state.order_status, state.payment_status, state.applied_events) == ("paid", "succeeded", 3)
    assert [r.event_id for r in s.dead_letter().collect()] == [3]
    (c,) = s.checkouts().collect()
    assert (c.customer_email, c.customer_name, c.customer_phone, c.session_id, c.payment_intent_id) == ("c@x", "Cy", "5", "cs_1", "pi_new")


def test_guards_look_at_earlier_segments(spark):
    """A fulfil and a refund in later segments depend on what earlier ones did."""
    s = small(spark, scratch_path(spark, "guard-test"), segment_seconds=60)
    command = lambda eid, order, what: (eid, T0 + dt.timedelta(minutes=eid), order, what)
    deliver(spark, s, [webhook(1, "payment_intent.succeeded", {"id": "pi_old"})], [command(0, "o1", "fulfill"), command(2, "o2", "refund")])
    deliver(spark, s, [webhook(5, "payment_intent.payment_failed", {"id": "pi_none"})], [command(6, "o1", "fulfill"), command(7, "o1", "fulfill"), command(8, "o1", "refund"), command(9, "o9", "refund")])
    got = {r.order_id: r for r in s.state().collect()}
    assert (got["o1"].order_status, got["o1"].payment_status, got["o1"].rejected_fulfills, got["o1"].rejected_refunds) == ("refunded", "refunded", 2, 0)
    assert got["o1"].fulfilled_at == T0 + dt.timedelta(minutes=6)
    assert (got["o2"].order_status, got["o2"].rejected_refunds) == ("pending", 1)
    assert sorted((r.event_type, r.seq) for r in s.event_log().collect()) == [("order_fulfilled", 7), ("order_refunded", 9), ("payment_succeeded", 2)]
    assert sorted((r.event_id, r.source) for r in s.dead_letter().collect()) == [(5, "webhook"), (9, "command")]


def test_raw_deliveries_equal_the_batch_ingest(spark, tmp_path):
    """Several small files a run, a bound on the bytes of a micro-batch, oversize and broken bodies, odd lines."""
    good = [webhook(i, "payment_intent.succeeded", {"id": f"pi_{i}", "amount": i}) for i in range(40)]
    odd = [(100, T0, "x" * 65_537), (101, T0, '{"id": "evt"'), (102, T0, ""), (103, T0, json.dumps({"type": "a\tb"})), (104, T0, "y" * 65_536)]
    payloads = spark.createDataFrame(good + odd, DELIVERY)
    root = scratch_path(spark, "raw-test")
    s = W.OrderStream(payloads, payloads, f"{root}/in", "", f"{root}/out", max_bytes=2000, partitions=2)
    for part in (payloads.filter("event_id < 20"), payloads.filter("event_id >= 20")):
        W.delivery_lines(part.repartition(5)).write.mode("append").text(s.deliveries)
        q = s.start_webhooks(available_now=True)
        q.awaitTermination()
        assert len(q.recentProgress) > 1  # the files did not come in one micro-batch
        s.start_rejects(available_now=True).awaitTermination()
    want = E.webhook_ingest(payloads).drop("charge")
    assert rows(s.webhooks().select(*want.columns)) == rows(want)
    assert {r.event_id: r.reject_reason for r in spark.read.parquet(s.path("rejects")).collect()} == {100: "payload_too_large", 101: "unreadable_payload", 102: "unreadable_payload", 104: "unreadable_payload"}
    lines = spark.createDataFrame([("no tabs at all",), ("",), ("7\t2024-01-01T00:00:00.000001\ta\tb",)], "value string")
    assert rows(W.parse_deliveries(lines)) == rows(spark.createDataFrame([(None, None, ""), (None, None, ""), (7, dt.datetime(2024, 1, 1, 0, 0, 0, 1), "a\tb")], DELIVERY))


def test_a_redelivery_in_a_later_batch_is_dropped(spark):
    """As the batch does with ``dedup=True``: the order stays fulfilled."""
    paid = webhook(1, "payment_intent.succeeded", {"id": "pi_old"}, "evt_a")
    again = webhook(9, "payment_intent.succeeded", {"id": "pi_old"}, "evt_a")
    other = webhook(10, "payment_intent.payment_failed", {"id": "pi_old"}, "evt_b")
    fulfil = (2, T0 + dt.timedelta(minutes=2), "o1", "fulfill")
    results = {}
    for dedup in (True, False):
        s = small(spark, scratch_path(spark, "dedup-test"), dedup=dedup)
        deliver(spark, s, [paid], [fulfil])
        deliver(spark, s, [again, other])
        batch = EventBatch(spark.createDataFrame([paid, again, other], DELIVERY), spark.createDataFrame([fulfil], W.COMMANDS), s.orders, s.payments, dedup=dedup)
        results[dedup] = rows(s.state())
        assert results[dedup] == rows(batch.fold.state.select(*STATE_COLUMNS))
    assert results[True][0][1] == "fulfilled" and results[False][0][1] == "paid"


def test_settings_are_the_users_again(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError), W._state_settings(spark, 17):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "17"
        raise ValueError
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass"))


def test_matching_rows_need_no_shuffle_of_events(spark, raw):
    """Events keep to their task until they are keyed: claims go to all salts of an id, events to one."""
    routed = E.route_webhooks(E.webhook_ingest(fx.webhook_payloads(raw)))
    got = W.match_rows(routed, fx.model_orders(raw), fx.model_payments(raw), salts=4)
    by = {r.kind: r for r in got.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.max("salt").alias("salt")).collect()}
    assert by["event"].n == by["event"].events and by["claim"].n % 4 == 0 and by["claim"].salt == 3


def test_keys_share_a_bucket_and_a_bucket_is_read_in_one_pass(spark, monkeypatch):
    """Many ids and orders in one call of a processor: the results follow the key, not the bucket, also in later micro-batches."""
    from paytrail.streaming import state as S

    one = lambda *key: F.lit(0).alias("bucket")
    monkeypatch.setattr(W, "bucket", one)
    n = 30
    orders = spark.createDataFrame([(f"o{i}", "a@x", None, None, "pending", T0, T0, None) for i in range(n)], ORDER)
    payments = spark.createDataFrame([(f"o{i}", f"pi_{i}", f"cs_{i}", "pending", None) for i in range(n)], PAYMENT)
    root = scratch_path(spark, "bucket-test")
    s = W.OrderStream(orders, payments, f"{root}/in", f"{root}/told", f"{root}/out", partitions=2)
    deliver(spark, s, [webhook(i, "checkout.session.completed", {"id": f"cs_{i}", "payment_intent": f"new_{i}", "customer_details": {"email": "é\"\t"}}) for i in range(0, n, 3)])
    deliver(spark, s, [webhook(100, "payment_intent.payment_failed", {"id": "new_3"}), webhook(101, "payment_intent.succeeded", {"id": "pi_4"})])  # few keys: asked one by one
    deliver(spark, s, [webhook(200 + i, "payment_intent.succeeded", {"id": f"new_{i}" if i % 2 else f"pi_{i}", "amount": 2**60 + i}) for i in range(n)])
    entries = s.summaries().filter("seg is not null").select("order_id", "seg")
    assert entries.count() == entries.distinct().count()
    got = {r.event_id: r.order_id for r in s.matched().collect()}
    assert got[100] == "o3" and got[101] == "o4"
    for i in range(n):  # every third order's intent id is the new one
        claimed = i % 3 == 0
        assert got[200 + i] == (f"o{i}" if claimed == bool(i % 2) else None), i
    assert {r.amount for r in s.matched().filter("event_id >= 200").collect()} == {2**60 + i for i in range(n)}
    assert {r.customer_email for r in s.matched().filter("event_id < 100").collect()} == {"é\"\t"}
    assert {k.order_id for k in s.state().filter("payment_status = 'succeeded'").collect()} == {f"o{i}" for i in range(n) if (i % 3 == 0) == bool(i % 2)} | {"o4"}
    assert S.BUCKETS > 1


def test_many_entries_take_few_calls_to_the_state():
    """A micro-batch of many keys writes far fewer rows than keys; a key later reads and writes its own row alone."""
    from paytrail.streaming.state import Entries

    calls = {"get": 0, "put": 0, "all": 0}

    class Map(dict):
        def iterator(self):
            calls["all"] += 1
            return iter(list(self.items()))

        def getValue(self, k):
            calls["get"] += 1
            return self.get(k)

        def updateValue(self, k, v):
            calls["put"] += 1
            self[k] = v

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    class Handle:
        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

    def batch(keys, value):
        calls.update(get=0, put=0, all=0)
        before = e.read({k: [] for k in keys})
        e.write({k: [value] for k in keys})
        return before

    e = Entries(Handle(), "owners", 2)
    keys = [(f"ö{i}", None if i % 10 == 0 else i) for i in range(3000)]
    assert batch(keys[:1000], "a") == {}
    assert calls["put"] <= 100
    assert batch(keys[:3], "b") == {k: ["a"] for k in keys[:3]}
    assert calls["put"] <= 3 and calls["get"] <= 3 and calls["all"] == 0
    assert batch(keys, "c") == {k: ["b"] if k in keys[:3] else ["a"] for k in keys[:1000]}   # the rows are dealt anew
    assert calls["put"] <= 300 and calls["all"] <= 2
    assert batch([], "d") == {} and calls["put"] == 0
    assert e.read({k: [] for k in keys}) == {k: ["c"] for k in keys}
    assert sum(len(json.loads(v[0])) for v in e.map.values()) == 3000
