"""Adapters from the driver's TPC-H-style tables to the order/payment model.

Every adapter is a pure DataFrame expression over whole tables; the same
rules are written as SQL CTEs in ``paytrail.plans.oracle`` for the DuckDB
oracle.  Modulo rules below decide *which kind* of row a source row becomes
(missing payment, truncated request, ...); they never drop rows to make a
query cheaper.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.sources.tables import RawTables

# Default clock for every report: leaves future-dated orders in the data.
AS_OF = "2001-07-15 12:00:00"


def stored(name: str, key: str | None = None, **fixed):
    """Serve an adapter from the session's model store when ``raw`` has one.

    ``fixed`` pins keyword arguments of the stored variant (e.g. orders are
    stored with the customer name; callers that skip it just ignore the column).
    """
    def deco(fn):
        @functools.wraps(fn)
        def wrapper(raw, *args, **kwargs):
            store = getattr(raw, "store", None)
            if store is None:
                return fn(raw, *args, **kwargs)
            return store.table(name, lambda: fn(raw, *args, **{**kwargs, **fixed}), key)
        return wrapper
    return deco


def _key_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


# ---------------------------------------------------------------- orders ---
@stored("orders", "id", with_customer=True)
def model_orders(raw: RawTables, with_customer: bool = True) -> DataFrame:
    o = raw.orders
    k = F.col("o_orderkey")
    low = F.col("o_orderpriority") == F.lit("5-LOW")
    status = (F.when(F.col("o_orderstatus") == "O", F.when(low, "created").otherwise("pending"))
              .when(F.col("o_orderstatus") == "F", F.when(low, "refunded").otherwise("fulfilled"))
              .when(F.col("o_orderstatus") == "P", F.when(low, "canceled").otherwise("paid")))
    created = F.when(k % 5 == 0, F.col("o_orderdate")).otherwise(
        F.timestamp_add("SECOND", k % 86400, F.col("o_orderdate")))
    email = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))
    phone = F.when(F.col("o_custkey") % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("555-"), (F.col("o_custkey") % 10000).cast("string")))
    df = o.select(
        _key_id("ORD", k).alias("id"),
        _key_id("TRK", k).alias("tracking_id"),
        email.alias("customer_email"),
        email.alias("customer_email_at_creation"),
        F.col("o_custkey"),
        phone.alias("customer_phone"),
        F.lit(None).cast("string").alias("customer_ip_address"),
        status.alias("status"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
        created.alias("created_at"),
    )
    df = df.withColumn("updated_at", F.col("created_at")).withColumn(
        "fulfilled_at",
        F.when(F.col("status") == "fulfilled", F.timestamp_add("DAY", F.lit(1), F.col("created_at"))))
    if with_customer:
        c = raw.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer_name"))
        df = df.join(c, "o_custkey", "left")
    else:
        df = df.withColumn("customer_name", F.lit(None).cast("string"))
    return df.select("id", "tracking_id", "customer_email", "customer_email_at_creation",
                     "customer_name", "customer_phone", "customer_ip_address", "status",
                     "metadata", "created_at", "updated_at", "fulfilled_at")


# -------------------------------------------------------------- payments ---
@stored("payments", "order_id")
def model_payments(raw: RawTables) -> DataFrame:
    o = raw.orders.filter(F.col("o_orderkey") % 10 != 9)
    k = F.col("o_orderkey")
    low = F.col("o_orderpriority") == F.lit("5-LOW")
    urgent = F.col("o_orderpriority") == F.lit("1-URGENT")
    pay_status = (F.when(F.col("o_orderstatus") == "O",
                         F.when(low, "pending").when(urgent, "failed").otherwise("pending"))
                  .when(F.col("o_orderstatus") == "F", F.when(low, "refunded").otherwise("succeeded"))
                  .when(F.col("o_orderstatus") == "P", F.when(low, "canceled").otherwise("succeeded")))
    created = F.when(k % 5 == 0, F.col("o_orderdate")).otherwise(
        F.timestamp_add("SECOND", k % 86400, F.col("o_orderdate")))
    return o.select(
        _key_id("ORD", k).alias("order_id"),
        _key_id("pi_", k).alias("payment_intent_id"),
        F.when(k % 3 == 0, _key_id("cs_", k)).alias("session_id"),
        (F.col("o_totalprice") * F.lit(100)).cast("long").alias("amount"),
        F.lit("usd").alias("currency"),
        pay_status.alias("status"),
        F.lit("card").alias("method"),
        F.when(pay_status.isin("succeeded", "refunded"),
               F.timestamp_add("HOUR", F.lit(1), created)).alias("processed_at"),
        F.lit(None).cast("timestamp_ntz").alias("refunded_at"),
        created.alias("created_at"), created.alias("updated_at"),
    )


# ----------------------------------------------------------------- items ---
@stored("order_items")
def model_items(raw: RawTables) -> DataFrame:
    """Order lines.  They meet their parts with few narrow columns and are then dealt once, by order; what only repeats the
    keys (ids as text, the price) is made after that shuffle."""
    li = raw.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    p = raw.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return li.join(p, "l_partkey", "inner").repartition("l_orderkey").sortWithinPartitions("l_orderkey").select(
        _key_id("ORD", F.col("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        _key_id("prod_", F.col("l_partkey")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("file_type"),
        item_price(F.col("l_partkey")).alias("price"),
        line_quantity().alias("quantity"),
        F.lit(None).cast("string").alias("download_url"),
        F.col("l_shipdate").alias("created_at"),
    )


def item_price(partkey: Column) -> Column:
    """Unit price in dollars with two decimals, exact as integer/100."""
    return ((partkey * 7) % 2000 + 99).cast("double") / F.lit(100.0)


def line_quantity() -> Column:
    return F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity").cast("int"))


# -------------------------------------------------------------- products ---
@stored("products", "id")
def model_products(raw: RawTables) -> DataFrame:
    p = raw.part
    k = F.col("p_partkey")
    return p.select(
        _key_id("prod_", k).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.array(F.concat(F.lit("https://cdn.example.com/img/"), k.cast("string"), F.lit(".png"))).alias("images"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("metadata"),
        (F.col("p_size") % 4 != 0).alias("active"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://files.example.com/dl/"), k.cast("string"))).alias("download_url"),
    )


# -------------------------------------------------------- provider intents ---
PROVIDER_STATES = ["succeeded", "canceled", "processing", "requires_payment_method",
                   "requires_confirmation", "requires_action", "requires_capture"]


@stored("provider_intents", "id")
def model_provider_intents(raw: RawTables) -> DataFrame:
    o = raw.orders.filter(F.col("o_orderkey") % 10 != 9)
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in PROVIDER_STATES])
    return o.select(
        _key_id("pi_", k).alias("id"),
        F.element_at(states, (k % 7 + 1).cast("int")).alias("status"),
        (F.col("o_totalprice") * F.lit(100)).cast("long").alias("amount"),
    )


# ----------------------------------------------------------- lookup keys ---
@stored("lookup_keys", "order_id")
def lookup_keys(raw: RawTables) -> DataFrame:
    """Requested keys: one per customer, some past the last order (not found)."""
    k = F.col("c_custkey") * 11
    return raw.customer.select(
        _key_id("ORD", k).alias("order_id"),
        _key_id("TRK", k).alias("tracking_id"),
        _key_id("pi_", k).alias("payment_intent_id"),
        _key_id("prod_", F.col("c_custkey") * 3).alias("product_id"),
    )


# ---------------------------------------------------- order request JSON ---
@stored("order_requests")
def order_requests(raw: RawTables) -> DataFrame:
    """One JSON request document per order (as a client would POST it).

    Lines meet their parts with few narrow columns and are then shuffled once, by order; what only repeats the keys (ids as
    text, the price) is made after that shuffle.
    """
    lines = raw.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = raw.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    k = F.col("l_partkey")
    items = lines.join(part, "l_partkey", "inner").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("request_key")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("l_linenumber").alias("line_no"), _key_id("prod_", k).alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("file_type"), item_price(k).alias("price"), line_quantity().alias("quantity")))).alias("lines"))
    o = raw.orders.select(
        F.col("o_orderkey").alias("request_key"),
        F.when(F.col("o_orderkey") % 53 == 0, F.lit("")).otherwise(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("email"),
        F.col("o_orderpriority"),
    )
    doc = o.join(items, "request_key", "left").select(
        "request_key",
        F.to_json(F.struct(
            F.struct(F.col("email").alias("email")).alias("customer_info"),
            F.coalesce(F.transform("lines", lambda x: x.dropFields("line_no")),
                       F.array().cast("array<struct<product_id:string,product_name:string,"
                                      "file_type:string,price:double,quantity:int>>")).alias("items"),
            F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("metadata"),
        )).alias("json"),
    )
    return doc.select(
        "request_key",
        F.when(F.col("request_key") % 97 == 0,
               F.expr("substring(json, 1, length(json) - 7)")).otherwise(F.col("json")).alias("payload"))


# ------------------------------------------------ webhooks and commands ---
def _event_kind() -> Column:
    et, v = F.col("event_type"), F.col("value")
    return (F.when(et == "purchase", "payment_intent.succeeded")
            .when(et == "error", "payment_intent.payment_failed")
            .when((et == "click") & (v < 60), "payment_intent.canceled")
            .when(et == "click", "command.refund")
            .when(et == "signup", "command.fulfill")
            .when((et == "view") & (v < 20), "checkout.session.completed")
            .when((et == "view") & (v < 60), "charge.dispute.created")
            .when((et == "view") & (v < 100), "invoice.payment_succeeded")
            .otherwise("customer.created"))


@stored("event_feed", "event_id")
def model_event_feed(raw: RawTables) -> DataFrame:
    """Driver events -> (event_id, ts, user_id, kind) in arrival order."""
    return raw.events.select("event_id", "ts", "user_id", "value", _event_kind().alias("kind"))


@stored("webhook_payloads", "event_id")
def webhook_payloads(raw: RawTables) -> DataFrame:
    """Provider webhook bodies as text (one envelope per webhook event)."""
    e = model_event_feed(raw).filter(~F.col("kind").startswith("command."))
    u, eid, kind = F.col("user_id"), F.col("event_id"), F.col("kind")
    details = F.when(eid % 5 == 0, F.lit(None)).otherwise(F.struct(
        F.when(eid % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit("u"), u.cast("string"), F.lit("."), (eid % 3).cast("string"),
                     F.lit("@example.com"))).alias("email"),
        F.when(eid % 2 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Buyer "), eid.cast("string"))).alias("name"),
        F.when(eid % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("555-"), eid.cast("string"))).alias("phone"),
    ))
    is_pi = kind.startswith("payment_intent.")
    is_cs = kind == "checkout.session.completed"
    obj = F.struct(
        (F.when(is_pi, _key_id("pi_", u)).when(is_cs, _key_id("cs_", u))
         .when(kind == "invoice.payment_succeeded", _key_id("in_", eid))
         .when(kind == "charge.dispute.created", _key_id("dp_", eid))
         .otherwise(_key_id("cus_", u))).alias("id"),
        F.when(is_pi, (F.col("value") * F.lit(100)).cast("long")).alias("amount"),
        F.when(is_pi, F.lit("usd")).alias("currency"),
        F.when(is_cs, _key_id("pi_", u)).alias("payment_intent"),
        F.when(kind == "charge.dispute.created", _key_id("ch_", u)).alias("charge"),
        F.when(is_cs, details).alias("customer_details"),
        F.when(eid % 997 == 0, F.repeat(F.lit("x"), 70000)).alias("description"),
    )
    env = F.to_json(F.struct(_key_id("evt_", eid).alias("id"), kind.alias("type"),
                             F.struct(obj.alias("object")).alias("data")))
    return e.withColumn("env", env).select(
        "event_id", "ts",
        F.when((eid % 101 == 0) & (eid % 997 != 0), F.expr("substring(env, 1, length(env) - 5)"))
        .otherwise(F.col("env")).alias("payload"))


@stored("commands", "event_id")
def model_commands(raw: RawTables) -> DataFrame:
    """Operator commands (fulfill / refund) addressed by order id."""
    e = model_event_feed(raw).filter(F.col("kind").startswith("command."))
    return e.select(
        "event_id", "ts",
        _key_id("ORD", F.col("user_id")).alias("order_id"),
        F.substring_index(F.col("kind"), ".", -1).alias("command"),
    )
