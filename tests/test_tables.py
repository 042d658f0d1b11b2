"""The stored event log, declared tables, lookup tables, typed event data, SQL functions and checks while writing."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from paytrail.functions.text import int_param
from paytrail.operators import intake as I
from paytrail.operators import quality as D
from paytrail.operators import reports as R
from paytrail.operators.event_data import typed_event_data
from paytrail.operators.fold import touch_payments
from paytrail.plans.q_events import payment_events
from paytrail.plans.q_tables import lookup_table
from paytrail.plans.sql_functions import FUNCTIONS, register_functions
from paytrail.session import scratch_path
from paytrail.schemas import PAYMENT_EVENTS
from paytrail.sources import declared as T
from paytrail.sources import eventlog as L
from paytrail.sources import fixtures as fx
from paytrail.sources import lookup as K
from paytrail.sources import sinks as S
from paytrail.sources.tables import read_model, write_model

T0 = dt.datetime(2024, 6, 15, 9, 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ----------------------------------------------------------------------- event log ---
def events(spark, *xs):
    return spark.createDataFrame([(f"e{i}", o, "order_created", "pending", "{}", T0 + dt.timedelta(hours=h), i) for i, (o, h) in enumerate(xs)], PAYMENT_EVENTS)


def test_a_batch_written_again_replaces_itself_alone(spark):
    path = scratch_path(spark, "log")
    first, second = events(spark, ("a", 0), ("b", 30)), events(spark, ("c", 0), ("c", 50))
    L.append_events(first, path, 0)
    before = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    L.append_events(second, path, 1)
    L.append_events(second, path, 1)  # as after a failure between the write and its report
    log = L.read_events(spark, path)
    assert rows(log.drop("period", "batch")) == rows(first.unionByName(second))
    assert before <= {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert [f for f in log.schema.fields if f.name in PAYMENT_EVENTS.names] == PAYMENT_EVENTS.fields
    assert sorted(r[0].isoformat() for r in log.select("period").distinct().collect()) == ["2024-06-15", "2024-06-16", "2024-06-17"]


def test_a_range_of_time_reads_its_periods_only(spark):
    path = scratch_path(spark, "log")
    L.append_events(events(spark, ("a", 0), ("a", 24), ("b", 48), ("b", 49)), path, 0)
    got = L.events_between(L.read_events(spark, path), T0 + dt.timedelta(hours=24), T0 + dt.timedelta(hours=49))
    assert [r.id for r in got.orderBy("seq").collect()] == ["e1", "e2"]
    p = plan(got)
    assert "PartitionFilters: [isnotnull(period" in p and "PushedFilters: [" in p
    with pytest.raises(ValueError):
        L.append_events(events(spark, ("a", 0)), path, 1, "YEARLY")


def test_queries_of_one_order_read_the_stored_log_once(spark, raw):
    log = payment_events(raw)
    p = plan(R.events_by_order(log, spark.createDataFrame([("ORD1",)], "order_id string")))
    assert p.count("FileScan parquet") == 1 and "Window" not in p


def test_creation_rows_follow_the_intent(spark):
    accepted = spark.createDataFrame([(1, "o1"), (2, "o2")], "request_key long, order_id string")
    intents = spark.createDataFrame([(2, "pi_2"), (3, "pi_3")], "request_key long, payment_intent_id string")
    (row,) = S.prepare_append(I.creation_events(accepted, intents), "2024-06-15 09:00:00").collect()
    assert (row.order_id, row.status, json.loads(row.data), row.created_at) == ("o2", "pending", {"payment_intent_id": "pi_2"}, T0) and row.id.startswith("evt_")


# ------------------------------------------------------------------ declared tables ---
def test_declared_defaults_limits_and_nulls(spark):
    names = T.create_tables(spark, scratch_path(spark, "declared"), "decl_test_", "TIMESTAMP_NTZ'2024-06-15 09:00:00'")
    T.insert(spark.createDataFrame([("o1", "t1", "a@x")], "id string, tracking_id string, customer_email string"), names["orders"])
    T.insert(spark.createDataFrame([("o2", "t2", "a@x", None)], "id string, tracking_id string, customer_email string, status string"), names["orders"])
    got = {r.id: r for r in spark.table(names["orders"]).collect()}
    assert (got["o1"].status, got["o1"].metadata, got["o1"].created_at, got["o1"].fulfilled_at) == ("created", {}, T0, None)
    assert got["o2"].status is None and got["o2"].updated_at == T0
    with pytest.raises(PySparkException, match="50"):
        T.insert(spark.createDataFrame([("x" * 51, "t", "e")], "id string, tracking_id string, customer_email string"), names["orders"])
    item = "order_id string, product_id string, product_name string, file_type string, price double"
    with pytest.raises(PySparkException):
        T.insert(spark.createDataFrame([("o1", "p", "n", "f", 1e8)], item), names["order_items"])
    T.insert(spark.createDataFrame([("o1", "p", "n", "f", 19.99)], item), names["order_items"])
    assert [(float(r.price), r.quantity) for r in spark.table(names["order_items"]).collect()] == [(19.99, 1)]
    assert spark.table(names["orders"]).count() == 2


def test_clock_default_is_the_time_of_the_insert(spark):
    names = T.create_tables(spark, scratch_path(spark, "declared"), "decl_clock_")
    T.insert(spark.createDataFrame([("o1", 5)], "order_id string, amount long"), names["payments"])
    r = spark.table(names["payments"]).first()
    assert (r.currency, r.status, r.method) == ("usd", "pending", "card") and abs((dt.datetime.now(dt.UTC).replace(tzinfo=None) - r.created_at).total_seconds()) < 600


def test_intake_rows_keep_all_their_columns(spark, raw):
    stored = I.stored_rows(I.accepted_orders(fx.order_requests(raw)), fx.AS_OF)
    root = scratch_path(spark, "intake-model")
    write_model(stored, root)
    back = read_model(spark, root)
    for name, df in stored.items():
        assert set(back[name].columns) == set(df.columns), name
        cols = [c for c, t in df.dtypes if not t.startswith("map")]
        assert back[name].select(*cols).exceptAll(df.select(*cols)).count() == 0


def test_checks_in_the_pass_that_writes(spark, raw):
    bad = fx.model_payments(raw).unionByName(spark.createDataFrame([(None, "pi", None, 1, "euro", "odd", "cash", None, None, None, None)], fx.model_payments(raw).schema))
    seen = T.Observed(bad, "payments")
    assert plan(seen.frame).count("CollectMetrics") == 1 and plan(seen.frame).count("Exchange") == 0
    path = scratch_path(spark, "observed")
    seen.frame.write.parquet(path)
    got = {(rule, c): n for _, rule, c, _, n in seen.violations()}
    assert got["enum", "status"] == got["enum", "method"] == got["required", "order_id"] == got["length", "currency"] == 1
    assert got["required", "amount"] == got["length", "order_id"] == 0
    tables = {"orders": fx.model_orders(raw), "order_items": fx.model_items(raw), "payments": bad, "payment_events": payment_events(raw)}
    assert {r.column_name: r.null_count for r in D.check_required(tables).filter("table_name = 'payments'").collect()} == {c: got["required", c] for c in D.REQUIRED["payments"]}


# -------------------------------------------------------------------- lookup tables ---
def test_a_lookup_shuffles_the_asking_side_alone(spark, raw):
    for query in ("events_to_orders_by_intent_indexed", "orders_by_tracking_indexed"):
        p = plan(entry.queries()[query](spark, SF_SMALL))
        join = p[p.index("SortMergeJoin"):]
        table = join[join.index("lookup_") - 400:] if "lookup_" in join else ""
        assert "Bucketed: true" in join and table, query
        assert "tracking_id" in query or "orders/" not in p  # no scan of the orders
        # the branch that ends in the lookup table has no exchange
        branch = [line for line in join.splitlines() if "FileScan" in line or "Exchange" in line]
        at = next(i for i, line in enumerate(branch) if "Bucketed: true" in line)
        assert sum("Exchange hashpartitioning" in line for line in branch[:at]) == sum("Exchange hashpartitioning" in line for line in branch)


def test_few_keys_reach_the_scan(spark, raw):
    name = lookup_table(raw, "tracking_id")
    df = K.lookup_few(spark, name, "tracking_id", ["TRK5"])
    assert "EqualTo(tracking_id,TRK5)" in plan(df)
    assert [r.order_id for r in df.collect()] == ["ORD5"]
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read <= spark.table(name).count() / 4  # the filters of the other files' row groups say no
    assert K.lookup_few(spark, name, "tracking_id", ["TRK5", "TRK6", "nowhere"]).count() == 2


def test_large_joins_take_a_bloom_filter_of_the_asked_keys(spark, raw):
    """At the default thresholds this needs tables of gigabytes; the test lowers them."""
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        asked = fx.lookup_keys(raw).filter("order_id like 'ORD11%'").select("tracking_id")
        df = asked.join(fx.model_orders(raw), "tracking_id")
        assert "might_contain" in plan(df)
        assert df.count() == asked.join(fx.model_orders(raw).select("tracking_id"), "tracking_id").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ------------------------------------------------------- VARIANT, functions, upsert ---
def test_event_members_have_types_and_bad_text_is_null(spark):
    log = spark.createDataFrame([("1", "o", "payment_succeeded", '{"payment_intent_id":"pi","amount":1998,"currency":"usd","payment_method":"card"}'),
                                 ("2", "o", "order_fulfilled", '{"fulfilled_at":"2024-06-15T09:00:00.000000Z"}'), ("3", "o", "x", "{broken"), ("4", "o", "x", None),
                                 ("5", "o", "x", '{"amount":"many","fulfilled_at":7}')], "id string, order_id string, event_type string, data string")
    got = {r.id: r.asDict() for r in typed_event_data(log).collect()}
    assert (got["1"]["amount"], got["1"]["payment_method"]) == (1998, "card") and got["2"]["fulfilled_at"] == T0
    for i in ("3", "4"):
        assert all(v is None for k, v in got[i].items() if k not in ("id", "order_id", "event_type"))
    assert got["5"]["amount"] is None


def test_sql_functions_are_inlined(spark):
    assert set(register_functions(spark)) == set(FUNCTIONS)
    p = plan(entry.queries()["sql_functions_report"](spark, SF_SMALL))
    assert "Python" not in p and "line_cents(" not in p and "map_provider_status(" not in p
    assert spark.sql("SELECT line_cents(19.99D, 1), line_cents(0.29D, 0), map_provider_status('requires_capture'), money_text(1998)").first()[:] == (1998, 28, "failed", "19.98")
    texts = ["5", "0", "-1", "+3", "", "x", "1.5", "99999999999999", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").selectExpr("int_param(t, 50, 1)").collect()]
    assert got == [int_param(t, 50, 1) if t != "99999999999999" else 50 for t in texts]


def test_upsert_applies_in_the_order_of_seq(spark):
    base = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, status string")
    ins = spark.createDataFrame([("a", "whole", 5), ("c", "whole", 5), ("d", "whole", 1), ("", "x", 1)], "id string, status string, seq int")
    upd = spark.createDataFrame([("a", "early", 1), ("b", "late", 9), ("b", "mid", 3), ("c", "early", 2), ("d", "after", 7), ("e", "lost", 1)], "id string, status string, seq int")
    snapshot, rejects = S.order_upsert(base, upd, ins)
    assert {r.id: (r.status, r.change) for r in snapshot.collect()} == {"a": ("whole", "replaced"), "b": ("late", "updated"), "c": ("whole", "inserted"), "d": ("after", "inserted")}
    assert sorted((r.id, r.operation) for r in rejects.collect()) == [("", "insert"), ("c", "update"), ("e", "update")]
    with pytest.raises(ValueError):
        S.order_upsert(base, upd, ins.drop("seq"))


def test_payments_are_touched_by_what_writes_them(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    ops = spark.createDataFrame([("o1", at(1), "succeeded", None), ("o1", at(2), "fulfill", None), ("o2", at(3), "refund", False), ("o3", at(4), "refund", True), ("o4", at(-9), "failed", None)],
                                "order_id string, ts timestamp_ntz, op string, intent_ok boolean")
    payments = spark.createDataFrame([(f"o{i}", T0) for i in range(1, 6)], "order_id string, updated_at timestamp_ntz")
    assert rows(touch_payments(ops, payments)) == [("o1", at(1)), ("o3", at(4)), ("o4", T0)]
