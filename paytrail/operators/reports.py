"""Reports over the order model: statistics, summaries, pages and lookups.

All functions take DataFrames and return DataFrames; the clock (``as_of``)
is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.functions.money import cents_to_dollars, line_cents
from paytrail.functions.text import int_param
from paytrail.operators.broadcast import broadcast_if_few, broadcast_if_small
from paytrail.schemas import DEFAULT_PAGE_LIMIT, MSG_ORDER_NOT_FOUND
from paytrail.session import materialize

COMPLETED = ("paid", "fulfilled")


def _ts(as_of) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _day_start(as_of) -> Column:
    return F.date_trunc("DAY", _ts(as_of)).cast("timestamp_ntz")


def _month_start(as_of) -> Column:
    return F.date_trunc("MONTH", _ts(as_of)).cast("timestamp_ntz")


def _amounts(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """orders LEFT JOIN payments on order id, narrow columns only."""
    p = payments.select(F.col("order_id").alias("id"), "amount", "currency",
                        F.col("status").alias("payment_status"))
    return orders.join(p, "id", "left")


# ------------------------------------------------------------------ A1 / A2 ---
def payment_stats_store(orders: DataFrame, payments: DataFrame, as_of) -> DataFrame:
    """One row of statistics with the in-memory store's rules.

    Revenue counts paid and fulfilled orders, in dollars; "today" and "this
    month" are strictly after the local day / month start with no upper bound;
    an order without payment counts 0.  Sums are taken in cents, then divided.
    """
    j = _amounts(orders.select("id", "status", "created_at"), payments)
    amt = F.coalesce(F.col("amount"), F.lit(0))
    done = F.col("status").isin(*COMPLETED)
    agg = j.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status") == "pending").alias("pending_orders"),
        F.count_if(done).alias("completed_orders"),
        F.count_if(F.col("status") == "refunded").alias("refunded_orders"),
        F.coalesce(F.sum(F.when(done, amt)), F.lit(0)).alias("rev_c"),
        F.coalesce(F.sum(F.when(done & (F.col("created_at") > _day_start(as_of)), amt)), F.lit(0)).alias("today_c"),
        F.coalesce(F.sum(F.when(done & (F.col("created_at") > _month_start(as_of)), amt)), F.lit(0)).alias("month_c"),
    )
    total_rev = cents_to_dollars(F.col("rev_c"))
    return agg.select(
        "total_orders",
        total_rev.alias("total_revenue"),
        "pending_orders",
        "completed_orders",
        "refunded_orders",
        F.when(F.col("completed_orders") > 0, total_rev / F.col("completed_orders"))
        .otherwise(F.lit(0.0)).alias("average_order_value"),
        cents_to_dollars(F.col("today_c")).alias("revenue_today"),
        cents_to_dollars(F.col("month_c")).alias("revenue_this_month"),
    )


def payment_stats_view(orders: DataFrame, payments: DataFrame, as_of) -> DataFrame:
    """One row of statistics with the SQL view's rules (cents, calendar day/month)."""
    j = _amounts(orders.select("id", "status", "created_at"), payments)
    done = F.col("status").isin(*COMPLETED)
    same_day = F.to_date(F.col("created_at")) == F.to_date(_ts(as_of))
    same_month = F.date_trunc("MONTH", F.col("created_at")) == F.date_trunc("MONTH", _ts(as_of))

    def rev(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("amount")).otherwise(F.lit(0))), F.lit(0)).cast("long")

    return j.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(done).alias("completed_orders"),
        F.count_if(F.col("status") == "pending").alias("pending_orders"),
        F.count_if(F.col("status") == "refunded").alias("refunded_orders"),
        rev(done).alias("total_revenue_cents"),
        rev(done & same_day).alias("revenue_today_cents"),
        rev(done & same_month).alias("revenue_this_month_cents"),
    )


# ---------------------------------------------------------------- A5 / A4 ---
def item_counts(items: DataFrame) -> DataFrame:
    """Items per order (partial + final hash aggregate)."""
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))


def order_total_cents(items: DataFrame, rounding: str = "parity") -> DataFrame:
    """Per order: sum of truncated line cents; quantity <= 0 counts as 1."""
    return items.groupBy("order_id").agg(
        F.sum(line_cents(F.col("price"), F.col("quantity"), rounding)).alias("total_cents"),
        F.count(F.lit(1)).alias("item_count"))


def customer_order_counts(orders: DataFrame) -> DataFrame:
    """Orders per customer, keyed by the email at creation (the index key)."""
    return orders.groupBy(F.col("customer_email_at_creation").alias("customer_email")).agg(
        F.count(F.lit(1)).alias("total_orders"))


# ------------------------------------------------------------------ A3 / J ---
def order_summaries_view(orders: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """View ``order_summaries``: items are counted before the join (no fan-out)."""
    o = orders.select("id", "tracking_id", "customer_email", F.col("status").alias("order_status"), "created_at")
    j = _amounts(o, payments)
    n = item_counts(items).withColumnRenamed("order_id", "id")
    return j.join(n, "id", "left").select(
        "id", "tracking_id", "customer_email", "order_status", "created_at", "amount", "currency",
        "payment_status", F.coalesce(F.col("item_count"), F.lit(0)).alias("item_count"))


def orders_with_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders LEFT JOIN payments (1:1)."""
    p = payments.select(
        F.col("order_id").alias("id"), "payment_intent_id", "session_id", "amount", "currency",
        F.col("status").alias("payment_status"), "method", "processed_at")
    return orders.select("id", "tracking_id", "customer_email", F.col("status").alias("order_status"),
                         "created_at").join(p, "id", "left")


def orders_with_items(orders: DataFrame, items: DataFrame, rounding: str = "parity") -> DataFrame:
    """Orders LEFT JOIN items, items pre-aggregated on order id."""
    t = order_total_cents(items, rounding).withColumnRenamed("order_id", "id")
    return orders.select("id", "status").join(t, "id", "left").select(
        "id", "status", F.coalesce(F.col("item_count"), F.lit(0)).alias("item_count"),
        F.coalesce(F.col("total_cents"), F.lit(0)).cast("long").alias("items_cents"))


def order_summary_projection(orders: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """P5: the store's 7-column summary; no payment -> amount 0 (embedded struct)."""
    j = _amounts(orders.select("id", "tracking_id", "customer_email", "status", "created_at"),
                 payments.select("order_id", "amount", "currency", "status"))
    n = item_counts(items).withColumnRenamed("order_id", "id")
    return j.join(n, "id", "left").select(
        "id", "tracking_id", "customer_email",
        cents_to_dollars(F.coalesce(F.col("amount"), F.lit(0))).alias("total_amount"),
        "status", F.coalesce(F.col("item_count"), F.lit(0)).alias("item_count"), "created_at")


# ----------------------------------------------------------------------- O1 ---
def _summaries_for_page(page: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """Join one page of orders to amounts and item counts.

    The page is cut once: it is checkpointed, then used by every join.
    """
    page = materialize(page)
    ids = broadcast_if_few(page.select("id"))
    pay = payments.select(F.col("order_id").alias("id"), "amount").join(ids, "id", "left_semi")
    n = item_counts(items.join(ids.withColumnRenamed("id", "order_id"), "order_id", "left_semi")) \
        .withColumnRenamed("order_id", "id")
    return (page.join(pay, "id", "left").join(n, "id", "left")
            .select("id", "tracking_id", "customer_email",
                    cents_to_dollars(F.coalesce(F.col("amount"), F.lit(0))).alias("total_amount"),
                    "status", F.coalesce(F.col("item_count"), F.lit(0)).alias("item_count"), "created_at")
            .orderBy(F.col("created_at").desc(), F.col("id").asc()))


def orders_page(orders: DataFrame, payments: DataFrame, items: DataFrame,
                limit=None, offset=None) -> DataFrame:
    """All orders newest first, one page (limit default 50, offset default 0).

    The page is cut on the orders alone (``TakeOrderedAndProject`` keeps at
    most offset+limit rows per partition); only the page's ids are then joined
    to payments and item counts.  Deep pages should use ``orders_page_after``.
    """
    lim = int_param(None if limit is None else str(limit), DEFAULT_PAGE_LIMIT, 1)
    off = int_param(None if offset is None else str(offset), 0, 0)
    page = (orders.select("id", "tracking_id", "customer_email", "status", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("id").asc())
            .offset(off).limit(lim))
    return _summaries_for_page(page, payments, items)


def orders_page_after(orders: DataFrame, payments: DataFrame, items: DataFrame,
                      after_created_at=None, after_id: str | None = None, limit=None) -> DataFrame:
    """Keyset form of ``orders_page``: the ``limit`` orders that follow the
    cursor ``(after_created_at, after_id)`` in the same order (newest first,
    id ascending).  Each partition keeps only ``limit`` rows however deep the
    page is.  No cursor gives the first page.
    """
    lim = int_param(None if limit is None else str(limit), DEFAULT_PAGE_LIMIT, 1)
    o = orders.select("id", "tracking_id", "customer_email", "status", "created_at")
    if after_created_at is not None:
        ts = F.lit(str(after_created_at)).cast("timestamp_ntz")
        o = o.filter((F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("id") > F.lit(after_id))))
    page = o.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(lim)
    return _summaries_for_page(page, payments, items)


# ------------------------------------------------------------------ lookups ---
def latest_by_tracking(orders: DataFrame) -> DataFrame:
    """One order per tracking id; the most recently created wins (ties: id)."""
    return (orders.filter(F.coalesce(F.col("tracking_id"), F.lit("")) != "")
            .groupBy("tracking_id")
            .agg(F.max(F.struct("created_at", "id"))["id"].alias("id")))


def _flat_order(o: DataFrame) -> DataFrame:
    return o.select("id", "tracking_id", "customer_email", "customer_name",
                    F.col("status").alias("order_status"),
                    F.col("metadata").getItem("priority").alias("metadata_priority"),
                    "created_at", "updated_at", "fulfilled_at")


def orders_by_id(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Key-set lookup; unmatched keys are reported as not found."""
    k = keys.select(F.col("order_id").alias("id")).distinct()
    hit = _flat_order(orders).join(broadcast_if_small(k), "id", "left_semi")
    # the marker comes from the matched side: an order may lack any other field
    found = F.coalesce(F.col("matched"), F.lit(False))
    return k.join(hit.withColumn("matched", F.lit(True)), "id", "left").select(
        F.col("id").alias("requested_id"), found.alias("found"),
        F.when(~found, F.lit(MSG_ORDER_NOT_FOUND)).alias("error"),
        *[c for c in hit.columns if c != "id"])


def orders_by_tracking(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookup by tracking id; the last order written with that id wins."""
    k = keys.select("tracking_id").distinct()
    latest = latest_by_tracking(orders.join(broadcast_if_small(k), "tracking_id", "left_semi"))
    hit = _flat_order(orders).drop("tracking_id").join(latest, "id", "inner")
    return k.join(hit, "tracking_id", "left").select(
        F.col("tracking_id").alias("requested_tracking_id"), F.col("id").isNotNull().alias("found"),
        F.col("id").alias("order_id"), "customer_email", "order_status", "created_at")


def events_by_order(event_log: DataFrame, keys: DataFrame) -> DataFrame:
    """Events of the requested orders in append order (order id, seq)."""
    k = broadcast_if_small(keys.select("order_id").distinct())
    return (event_log.join(k, "order_id", "left_semi")
            .select("order_id", "seq", F.col("id").alias("event_id"), "event_type",
                    F.col("status").alias("event_status"), "created_at")
            .orderBy("order_id", "seq"))


def payment_status(orders: DataFrame, payments: DataFrame, keys: DataFrame) -> DataFrame:
    """8-column status of requested orders (store semantics: no payment ->
    amount 0 and empty strings)."""
    k = keys.select(F.col("order_id").alias("id")).distinct()
    kb = broadcast_if_small(k)
    o = orders.select("id", "tracking_id", F.col("status").alias("order_status"), "created_at",
                      "updated_at").join(kb, "id", "left_semi")
    j = _amounts(o, payments.join(kb.withColumnRenamed("id", "order_id"), "order_id", "left_semi"))
    hit = j.select(
        F.col("id").alias("order_id"), "tracking_id",
        F.coalesce(F.col("payment_status"), F.lit("")).alias("payment_status"), "order_status",
        F.coalesce(F.col("amount"), F.lit(0)).alias("amount"),
        F.coalesce(F.col("currency"), F.lit("")).alias("currency"), "created_at", "updated_at")
    return k.withColumnRenamed("id", "order_id").join(hit.withColumn("found", F.lit(True)), "order_id", "left") \
        .withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def track_payment(orders: DataFrame, event_log: DataFrame, keys: DataFrame) -> DataFrame:
    """Order by tracking id plus its events, one row per event (flat).

    An order without events yields one row with null event columns; an
    unknown tracking id yields one row with ``found = false``.  The event log
    is always the streamed side of its join (an order with a huge history
    is split by AQE or meets a broadcast), and the "no events" rows come
    from an anti join against the distinct order ids of the log.
    """
    k = keys.select("tracking_id").distinct()
    latest = latest_by_tracking(orders.select("id", "tracking_id", "created_at")
                                .join(broadcast_if_small(k), "tracking_id", "left_semi"))
    o = orders.select("id", "status").join(latest, "id", "inner")
    ev = event_log.select(F.col("order_id").alias("id"), F.col("id").alias("event_id"), "event_type",
                          F.col("status").alias("event_status"), "seq")
    cols = ["tracking_id", "found", "order_id", "order_status", "event_id", "event_type", "event_status", "seq"]
    with_events = ev.join(broadcast_if_small(o), "id", "inner").select(
        "tracking_id", F.lit(True).alias("found"), F.col("id").alias("order_id"),
        F.col("status").alias("order_status"), "event_id", "event_type", "event_status", "seq")
    ev_ids = ev.select("id").distinct()  # partial aggregate: a hot order collapses map-side
    without_events = o.join(ev_ids, "id", "left_anti").select(
        "tracking_id", F.lit(True).alias("found"), F.col("id").alias("order_id"),
        F.col("status").alias("order_status"), F.lit(None).cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("event_status"),
        F.lit(None).cast("long").alias("seq"))
    unknown = k.join(latest.select("tracking_id"), "tracking_id", "left_anti").select(
        "tracking_id", F.lit(False).alias("found"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("order_id", "string"), ("order_status", "string"), ("event_id", "string"), ("event_type", "string"),
            ("event_status", "string"), ("seq", "long"))])
    return with_events.select(*cols).unionByName(without_events.select(*cols)).unionByName(unknown.select(*cols))


def customer_orders(orders: DataFrame, emails: DataFrame) -> DataFrame:
    """A customer's orders newest first, with ``total_orders``.

    Keyed by the email at creation (the reference never re-indexes).  The
    orders are the streamed side of an inner join with the per-customer
    counts (a partial aggregate), so a customer holding a third of all
    orders is split by AQE or meets a broadcast; customers without orders
    come from an anti join.  The final order is a global range sort.
    """
    e = emails.select("customer_email").distinct()
    o = orders.select(F.col("customer_email_at_creation").alias("customer_email"), "id", "status",
                      "created_at").join(broadcast_if_small(e), "customer_email", "left_semi")
    counts = o.groupBy("customer_email").agg(F.count(F.lit(1)).alias("total_orders"))
    with_orders = o.join(broadcast_if_small(counts), "customer_email", "inner").select(
        "customer_email", "total_orders", F.col("id").alias("order_id"), F.col("status").alias("order_status"),
        "created_at")
    without = e.join(counts.select("customer_email"), "customer_email", "left_anti").select(
        "customer_email", F.lit(0).cast("long").alias("total_orders"), F.lit(None).cast("string").alias("order_id"),
        F.lit(None).cast("string").alias("order_status"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return (with_orders.unionByName(without)
            .orderBy("customer_email", F.col("created_at").desc(), F.col("order_id").asc()))


# ----------------------------------------------------------------------- A7 ---
ITEM_FIELDS = ("product_id", "product_name", "file_type", "price", "quantity", "download_url")


def assemble_orders(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Four flat tables -> nested order documents (one row per order).

    Items are gathered per order, which bounds a document by its order's
    lines; reports never go through this form.  They are dealt by order first:
    gathering part of them before the shuffle would make no fewer bytes.
    """
    it = items.repartition("order_id").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", *ITEM_FIELDS))).alias("lines"))
    p = payments.select(F.col("order_id"), F.struct(
        "payment_intent_id", "session_id", "amount", "currency", "status", "method",
        "processed_at", "refunded_at").alias("payment"))
    o = orders.select(
        "id", "tracking_id",
        F.struct(F.col("customer_email").alias("email"), F.col("customer_name").alias("name"),
                 F.col("customer_phone").alias("phone"),
                 F.col("customer_ip_address").alias("ip_address")).alias("customer_info"),
        "status", "metadata", "created_at", "updated_at", "fulfilled_at")
    return (o.join(it.withColumnRenamed("order_id", "id"), "id", "left")
            .join(p.withColumnRenamed("order_id", "id"), "id", "left")
            .select("id", "tracking_id", "customer_info",
                    F.coalesce(F.transform("lines", lambda x: x.dropFields("line_no")),
                               F.array().cast("array<struct<product_id:string,product_name:string,"
                                              "file_type:string,price:double,quantity:int,"
                                              "download_url:string>>")).alias("items"),
                    "payment", "status", "metadata", "created_at", "updated_at", "fulfilled_at"))


def explode_orders(nested: DataFrame) -> DataFrame:
    """Inverse of ``assemble_orders`` for the items: one row per line."""
    return nested.select("id", F.posexplode_outer("items").alias("pos", "item")).select(
        F.col("id").alias("order_id"), "pos", *[F.col(f"item.{f}").alias(f) for f in ITEM_FIELDS])
