"""Intake and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import catalogue as C
from paytrail.operators import intake as I
from paytrail.plans.base import query
from paytrail.plans.oracle import AS_OF
from paytrail.sources import fixtures as fx

REQ_ITEMS_SQL = "(SELECT order_id, count(*) AS n, CAST(sum(line_cents) AS BIGINT) AS cents FROM m_item_cents GROUP BY order_id)"


@query("order_requests_ingest", f"""
SELECT o.o_orderkey AS request_key, (o.o_orderkey % 97 <> 0) AS decoded,
       CASE WHEN o.o_orderkey % 97 <> 0 THEN
         CASE WHEN o.o_orderkey % 53 = 0 THEN '' ELSE 'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' END
       END AS customer_email,
       CASE WHEN o.o_orderkey % 97 <> 0 THEN CAST(coalesce(n.n, 0) AS INTEGER) END AS item_count,
       CASE WHEN o.o_orderkey % 97 <> 0 THEN o.o_orderpriority END AS metadata_priority
FROM orders o LEFT JOIN {REQ_ITEMS_SQL} n ON n.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR)""")
def order_requests_ingest(raw):
    """IO2: decode JSON order requests; undecodable text is flagged, not dropped."""
    return I.order_requests_ingest(fx.order_requests(raw))


@query("validate_order_requests", f"""
SELECT o.o_orderkey AS request_key,
       (o.o_orderkey % 97 <> 0 AND o.o_orderkey % 53 <> 0 AND coalesce(n.n, 0) > 0) AS valid,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'Invalid request body'
            WHEN o.o_orderkey % 53 = 0 THEN 'Customer email is required'
            WHEN coalesce(n.n, 0) = 0 THEN 'At least one item is required' END AS reason
FROM orders o LEFT JOIN {REQ_ITEMS_SQL} n ON n.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR)""")
def validate_order_requests(raw):
    """First failing rule wins."""
    return I.validate_order_requests(fx.order_requests(raw))


NEW_ORDER = "'ORD' || substr(sha256(CAST(o.o_orderkey AS VARCHAR)), 1, 16)"
VALID = "o.o_orderkey % 97 <> 0 AND o.o_orderkey % 53 <> 0"


def _stored(raw, table):
    return I.stored_rows(I.accepted_orders(fx.order_requests(raw)), fx.AS_OF)[table]


@query("intake_orders", f"""
SELECT {NEW_ORDER} AS id, 'TRK' || substr(sha256('t:' || CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS tracking_id,
       'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS customer_email,
       'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS customer_email_at_creation,
       CAST(NULL AS VARCHAR) AS customer_name, CAST(NULL AS VARCHAR) AS customer_phone,
       CAST(NULL AS VARCHAR) AS customer_ip_address, 'created' AS status, o.o_orderpriority AS metadata_priority,
       {AS_OF} AS created_at, {AS_OF} AS updated_at, CAST(NULL AS TIMESTAMP) AS fulfilled_at
FROM orders o WHERE {VALID}
  AND 'ORD' || CAST(o.o_orderkey AS VARCHAR) IN (SELECT order_id FROM m_items)""")
def intake_orders(raw):
    """Accepted requests as rows of the orders table, all columns."""
    return _stored(raw, "orders").withColumn("metadata_priority", F.col("metadata").getItem("priority")).drop("metadata")


@query("intake_items", f"""
SELECT {NEW_ORDER} AS order_id,
       CAST(row_number() OVER (PARTITION BY i.order_id ORDER BY i.line_no, i.product_id, i.product_name, i.file_type,
                               i.price, i.quantity) AS INTEGER) AS line_no,
       i.product_id, i.product_name, i.file_type, i.price,
       CASE WHEN i.quantity <= 0 THEN 1 ELSE i.quantity END AS quantity, CAST(NULL AS VARCHAR) AS download_url,
       {AS_OF} AS created_at
FROM orders o JOIN m_items i ON i.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR) WHERE {VALID}""")
def intake_items(raw):
    """The lines of accepted requests as rows of the order_items table."""
    return _stored(raw, "order_items")


@query("intake_payments", f"""
SELECT {NEW_ORDER} AS order_id, CAST(NULL AS VARCHAR) AS payment_intent_id, CAST(NULL AS VARCHAR) AS session_id,
       n.cents AS amount, 'usd' AS currency, 'pending' AS status, 'card' AS method,
       CAST(NULL AS TIMESTAMP) AS processed_at, CAST(NULL AS TIMESTAMP) AS refunded_at,
       {AS_OF} AS created_at, {AS_OF} AS updated_at
FROM orders o JOIN {REQ_ITEMS_SQL} n ON n.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR) WHERE {VALID}""")
def intake_payments(raw):
    """The pending payments of accepted requests as rows of the payments table."""
    return _stored(raw, "payments")


@query("payment_intent_requests", f"""
SELECT o.o_orderkey AS request_key,
       'ORD' || substr(sha256(CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS order_id,
       'TRK' || substr(sha256('t:' || CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS tracking_id,
       n.cents AS amount, 'usd' AS currency,
       'ORD' || substr(sha256(CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS meta_order_id,
       'TRK' || substr(sha256('t:' || CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS meta_tracking_id,
       'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS meta_customer_email
FROM orders o JOIN {REQ_ITEMS_SQL} n ON n.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR)
WHERE o.o_orderkey % 97 <> 0 AND o.o_orderkey % 53 <> 0""")
def payment_intent_requests(raw):
    """P12 (+A4/S2 on requests): intents to create for accepted orders."""
    r = I.payment_intent_requests(fx.order_requests(raw))
    return r.select("request_key", "order_id", "tracking_id", "amount", "currency",
                    *[F.col("metadata").getItem(k).alias(f"meta_{k}")
                      for k in ("order_id", "tracking_id", "customer_email")])


def legacy_intent_requests(raw):
    """Direct intent requests, one per payment; some omit currency / metadata."""
    p = raw.orders.filter(F.col("o_orderkey") % 10 != 9)
    k = F.col("o_orderkey")
    oid = F.concat(F.lit("ORD"), k.cast("string"))
    return p.select(oid.alias("ref"), F.concat(F.lit("Order "), oid).alias("description"),
                    (F.col("o_totalprice") * F.lit(100)).cast("long").alias("amount"),
                    F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("usd")).alias("currency"),
                    F.when(k % 4 == 0, F.create_map(F.lit("order_id"), oid)).alias("metadata"))


def legacy_checkout_requests(raw):
    """Checkout-session requests, one per order line."""
    i = fx.model_items(raw)
    ln = F.col("line_no")
    return i.select(F.col("order_id").alias("ref"), "line_no", "product_name",
                    (F.col("price") * F.lit(100.0)).cast("long").alias("amount"),
                    F.when(ln % 2 == 0, F.lit("")).otherwise(F.lit("eur")).alias("currency"),
                    F.when(ln % 3 == 0, F.lit("https://shop.example.com/ok")).otherwise(F.lit("")).alias("success_url"),
                    F.lit(None).cast("string").alias("cancel_url"))


@query("provider_request_defaults", """
SELECT 'payment_intent' AS request_kind, 'ORD' || CAST(o_orderkey AS VARCHAR) AS ref,
       CAST(NULL AS INTEGER) AS line_no, 'Order ORD' || CAST(o_orderkey AS VARCHAR) AS name,
       CAST(trunc(o_totalprice * 100) AS BIGINT) AS amount, 'usd' AS currency,
       CAST(NULL AS VARCHAR) AS success_url, CAST(NULL AS VARCHAR) AS cancel_url,
       CAST(NULL AS BIGINT) AS quantity, CAST(NULL AS VARCHAR) AS method_types,
       CASE WHEN o_orderkey % 4 = 0 THEN 'ORD' || CAST(o_orderkey AS VARCHAR) END AS metadata_order_id
FROM orders WHERE o_orderkey % 10 <> 9
UNION ALL
SELECT 'checkout_session', order_id, line_no, product_name,
       CAST(trunc(price * CAST(100 AS DOUBLE)) AS BIGINT),
       CASE WHEN line_no % 2 = 0 THEN 'usd' ELSE 'eur' END,
       CASE WHEN line_no % 3 = 0 THEN 'https://shop.example.com/ok' ELSE 'https://your-domain.com/success' END,
       'https://your-domain.com/cancel', 1, 'card', NULL
FROM m_items""")
def provider_request_defaults(raw):
    """Legacy intent / checkout requests with defaults filled in."""
    r = I.provider_request_defaults(legacy_intent_requests(raw), legacy_checkout_requests(raw))
    return r.select("request_kind", "ref", "line_no", "name", "amount", "currency", "success_url",
                    "cancel_url", "quantity", F.array_join("method_types", ",").alias("method_types"),
                    F.col("metadata").getItem("order_id").alias("metadata_order_id"))


# ---------------------------------------------------------------- catalogue ---
@query("verify_payment", """
SELECT k.payment_intent_id AS requested_id, i.id IS NOT NULL AS found, i.status, i.amount
FROM (SELECT DISTINCT payment_intent_id FROM m_keys) k LEFT JOIN m_intents i ON i.id = k.payment_intent_id""")
def verify_payment(raw):
    """Provider intent lookup by id."""
    return C.verify_payment(fx.model_provider_intents(raw), fx.lookup_keys(raw))


@query("active_products", """
SELECT id, name, description, image_1, 1 AS n_images, brand FROM m_products WHERE active""")
def active_products(raw):
    """All active products."""
    return C.active_products(fx.model_products(raw))


@query("products_by_id", """
SELECT k.product_id AS requested_id, p.id IS NOT NULL AS found, p.name, p.description, p.image_1,
       CASE WHEN p.id IS NOT NULL THEN 1 END AS n_images, p.brand
FROM (SELECT DISTINCT product_id FROM m_keys) k LEFT JOIN m_products p ON p.id = k.product_id""")
def products_by_id(raw):
    """Product lookup by id."""
    return C.products_by_id(fx.model_products(raw), fx.lookup_keys(raw))
