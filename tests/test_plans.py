"""Physical-plan properties that matter at scale."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from paytrail.operators import reports as R
from paytrail.sources import fixtures as fx
from paytrail.sources.tables import RawTables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_is_cut_before_the_joins(raw):
    df = R.orders_page(fx.model_orders(raw, with_customer=False), fx.model_payments(raw), fx.model_items(raw), 10, 5)
    p = _plan(df)
    # the page was cut before: its rows come from the checkpoint and no scan reads the orders again
    assert "Scan ExistingRDD" in p
    assert "tracking_id:" not in p and "created_at:" not in p
    assert df.count() == 10


def test_stats_scan_is_pruned(raw):
    """The statistics read only the order columns they use from the stored model."""
    import re
    df = R.payment_stats_store(fx.model_orders(raw, with_customer=False), fx.model_payments(raw), fx.AS_OF)
    p = _plan(df)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    order_scan = [sch for sch in schemas if "status" in sch and "created_at" in sch]
    assert order_scan, p
    cols = {c.split(":")[0] for c in order_scan[0].split(",")}
    assert cols == {"id", "status", "created_at"}


def test_item_counts_uses_partial_aggregation(raw):
    p = _plan(R.item_counts(fx.model_items(raw)))
    assert p.count("HashAggregate") >= 2  # partial (map side) + final


def test_active_products_filter_reaches_the_scan(raw):
    from paytrail.operators import catalogue as C
    assert "EqualTo(active,true)" in _plan(C.active_products(fx.model_products(raw)))


def test_one_webhook_type_is_filtered_before_matching(spark):
    """The query of one type writes no feed: its type filter sits on the decoded rows below the join."""
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    p = _plan(entry.queries()["apply_payment_failed"](spark, SF_SMALL))
    assert "Scan ExistingRDD" not in p and "payment_intent.payment_failed" in p


def test_lines_are_shuffled_narrow_and_gathered_after_one_shuffle(spark):
    """Lines are dealt by order before ids and prices are made of their keys; a document gathers its lines in the shuffle's reader."""
    raw = RawTables(spark, SF_SMALL, store=False)
    plan = fx.model_items(raw)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(l_orderkey" in plan
    items = spark.createDataFrame([("o1", i, f"p{i}", "n", "t", 1.0, 1, None) for i in (2, 1, 3)] * 2,
                                  "order_id string, line_no int, product_id string, product_name string, file_type string, price double, quantity int, download_url string")
    nested = R.assemble_orders(fx.model_orders(raw).limit(1).withColumn("id", F.lit("o1")), items, fx.model_payments(raw))
    gather = [x for x in nested._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_list" in x or "Exchange hashpartitioning(order_id" in x]
    assert ["collect_list" in x for x in gather[:3]] == [True, True, False]   # final and partial step, then the exchange
    assert [x.product_id for x in nested.first()["items"]] == ["p1", "p1", "p2", "p2", "p3", "p3"]


def test_enum_check_builds_only_the_tables_it_checks(spark, monkeypatch):
    from paytrail.plans import q_quality as Q

    empty = {t: spark.createDataFrame([], "status string, method string") for t in Q.MODEL}
    built = []
    for t in Q.MODEL:
        monkeypatch.setitem(Q.MODEL, t, lambda raw, t=t: built.append(t) or empty[t])
    assert Q.check_enums(None).count() == 4
    assert built == ["orders", "payments", "payment_events"]
