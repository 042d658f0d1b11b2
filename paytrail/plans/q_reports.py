"""Report queries (sources, projections, joins, aggregations, paging)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.functions.money import line_cents
from paytrail.operators import reports as R
from paytrail.plans.base import query
from paytrail.plans.oracle import AS_OF
from paytrail.sources import fixtures as fx

PAGE_LIMIT, PAGE_OFFSET = 25, 20

# ------------------------------------------------------------------ sources ---
ORDER_COLS = ("id, tracking_id, customer_email, customer_email_at_creation, customer_name, "
              "customer_phone, customer_ip_address, status, metadata_priority, created_at, "
              "updated_at, fulfilled_at")


@query("scan_orders", f"SELECT {ORDER_COLS} FROM m_orders_full")
def scan_orders(raw):
    """IO1: the orders table of the model (metadata flattened to its key)."""
    o = fx.model_orders(raw)
    return o.select(*[c for c in o.columns if c != "metadata"],
                    F.col("metadata").getItem("priority").alias("metadata_priority"))


@query("scan_items", "SELECT * FROM m_items")
def scan_items(raw):
    """IO1: order items."""
    return fx.model_items(raw)


@query("scan_payments", "SELECT * FROM m_payments_full")
def scan_payments(raw):
    """IO1: payments (one per order at most)."""
    return fx.model_payments(raw)


# --------------------------------------------------------------- statistics ---
@query("payment_stats_store", f"""
, s AS (
  SELECT count(*) AS total_orders,
         count(*) FILTER (WHERE o.status = 'pending') AS pending_orders,
         count(*) FILTER (WHERE o.status IN ('paid', 'fulfilled')) AS completed_orders,
         count(*) FILTER (WHERE o.status = 'refunded') AS refunded_orders,
         CAST(coalesce(sum(coalesce(p.amount, 0)) FILTER (WHERE o.status IN ('paid', 'fulfilled')), 0)
              AS DOUBLE) / 100.0 AS total_revenue,
         CAST(coalesce(sum(coalesce(p.amount, 0)) FILTER (WHERE o.status IN ('paid', 'fulfilled')
              AND o.created_at > date_trunc('day', {AS_OF})), 0) AS DOUBLE) / 100.0 AS revenue_today,
         CAST(coalesce(sum(coalesce(p.amount, 0)) FILTER (WHERE o.status IN ('paid', 'fulfilled')
              AND o.created_at > date_trunc('month', {AS_OF})), 0) AS DOUBLE) / 100.0 AS revenue_this_month
  FROM m_orders o LEFT JOIN m_payments p ON p.order_id = o.id)
SELECT total_orders, total_revenue, pending_orders, completed_orders, refunded_orders,
       CASE WHEN completed_orders > 0 THEN total_revenue / completed_orders ELSE 0.0 END
         AS average_order_value,
       revenue_today, revenue_this_month
FROM s""")
def payment_stats_store(raw):
    """A1: statistics with the in-memory store's rules."""
    return R.payment_stats_store(fx.model_orders(raw, with_customer=False), fx.model_payments(raw), fx.AS_OF)


@query("payment_stats_view", f"""
, done AS (SELECT o.created_at, coalesce(p.amount, 0) AS cents
           FROM m_orders o LEFT JOIN m_payments p ON p.order_id = o.id WHERE o.status IN ('paid', 'fulfilled')),
rev AS (SELECT sum(cents) AS total,
               sum(cents) FILTER (WHERE created_at::DATE = ({AS_OF})::DATE) AS today,
               sum(cents) FILTER (WHERE strftime(created_at, '%Y-%m') = strftime({AS_OF}, '%Y-%m')) AS month
        FROM done),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('paid', 'fulfilled')) AS completed,
             count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'refunded') AS refunded
      FROM m_orders)
SELECT n.total AS total_orders, n.completed AS completed_orders, n.pending AS pending_orders,
       n.refunded AS refunded_orders, CAST(coalesce(rev.total, 0) AS BIGINT) AS total_revenue_cents,
       CAST(coalesce(rev.today, 0) AS BIGINT) AS revenue_today_cents,
       CAST(coalesce(rev.month, 0) AS BIGINT) AS revenue_this_month_cents
FROM n, rev""")
def payment_stats_view(raw):
    """A2: statistics with the SQL view's rules."""
    return R.payment_stats_view(fx.model_orders(raw, with_customer=False), fx.model_payments(raw), fx.AS_OF)


# ------------------------------------------------------------- summaries ---
@query("order_summaries_view", """
, lines AS (SELECT order_id, count(*) AS n FROM m_items GROUP BY order_id)
SELECT o.id, o.tracking_id, o.customer_email, o.status AS order_status, o.created_at,
       p.amount, p.currency, p.status AS payment_status, coalesce(lines.n, 0) AS item_count
FROM m_orders o LEFT JOIN lines ON lines.order_id = o.id LEFT JOIN m_payments p ON p.order_id = o.id""")
def order_summaries_view(raw):
    """A3: the ``order_summaries`` view."""
    return R.order_summaries_view(fx.model_orders(raw, with_customer=False), fx.model_payments(raw),
                                  fx.model_items(raw))


@query("item_counts", "SELECT order_id, count(*) AS item_count FROM m_items GROUP BY order_id")
def item_counts(raw):
    """A5: items per order."""
    return R.item_counts(fx.model_items(raw))


@query("order_total_cents", """
SELECT order_id, CAST(sum(line_cents) AS BIGINT) AS total_cents, count(*) AS item_count
FROM m_item_cents GROUP BY order_id""")
def order_total_cents(raw):
    """A4: order totals in cents (truncating lines, qty <= 0 -> 1)."""
    return R.order_total_cents(fx.model_items(raw))


@query("customer_order_counts", """
SELECT customer_email_at_creation AS customer_email, count(*) AS total_orders
FROM m_orders GROUP BY customer_email_at_creation""")
def customer_order_counts(raw):
    """Orders per customer email (at creation)."""
    return R.customer_order_counts(fx.model_orders(raw, with_customer=False))


@query("line_totals", """
SELECT order_id, line_no, product_id, price, quantity, line_cents,
       CAST(round(CAST(price AS DECIMAL(10, 2)) * 100
            * CAST(CASE WHEN quantity <= 0 THEN 1 ELSE quantity END AS DECIMAL(10, 0)), 0) AS BIGINT)
         AS line_cents_exact
FROM m_item_cents""")
def line_totals(raw):
    """Per-line cents, truncating (parity) and exact decimal."""
    i = fx.model_items(raw)
    return i.select("order_id", "line_no", "product_id", "price", "quantity",
                    line_cents(F.col("price"), F.col("quantity")).alias("line_cents"),
                    line_cents(F.col("price"), F.col("quantity"), "exact").alias("line_cents_exact"))


# ------------------------------------------------------------------- joins ---
@query("orders_with_payments", """
SELECT o.id, o.tracking_id, o.customer_email, o.status AS order_status, o.created_at,
       p.payment_intent_id, p.session_id, p.amount, p.currency, p.status AS payment_status,
       p.method, p.processed_at
FROM m_orders o LEFT JOIN m_payments_full p ON p.order_id = o.id""")
def orders_with_payments(raw):
    """Orders LEFT JOIN payments."""
    return R.orders_with_payments(fx.model_orders(raw, with_customer=False), fx.model_payments(raw))


@query("orders_with_items", """
SELECT o.id, o.status, count(i.order_id) AS item_count,
       CAST(coalesce(sum(i.line_cents), 0) AS BIGINT) AS items_cents
FROM m_orders o LEFT JOIN m_item_cents i ON i.order_id = o.id
GROUP BY o.id, o.status""")
def orders_with_items(raw):
    """Orders LEFT JOIN items (items pre-aggregated)."""
    return R.orders_with_items(fx.model_orders(raw, with_customer=False), fx.model_items(raw))


@query("order_summary_projection", """
SELECT o.id, o.tracking_id, o.customer_email,
       CAST(coalesce(p.amount, 0) AS DOUBLE) / 100.0 AS total_amount, o.status,
       coalesce(n.item_count, 0) AS item_count, o.created_at
FROM m_orders o
LEFT JOIN m_payments p ON p.order_id = o.id
LEFT JOIN (SELECT order_id, count(*) AS item_count FROM m_items GROUP BY order_id) n ON n.order_id = o.id""")
def order_summary_projection(raw):
    """P5: the store's order summaries for all orders."""
    return R.order_summary_projection(fx.model_orders(raw, with_customer=False), fx.model_payments(raw),
                                      fx.model_items(raw))


@query("orders_page", f"""
SELECT o.id, o.tracking_id, o.customer_email,
       CAST(coalesce(p.amount, 0) AS DOUBLE) / 100.0 AS total_amount, o.status,
       coalesce(n.item_count, 0) AS item_count, o.created_at
FROM m_orders o
LEFT JOIN m_payments p ON p.order_id = o.id
LEFT JOIN (SELECT order_id, count(*) AS item_count FROM m_items GROUP BY order_id) n ON n.order_id = o.id
ORDER BY o.created_at DESC, o.id ASC LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}""")
def orders_page(raw):
    """O1: one page of all orders, newest first (limit 25, offset 20)."""
    return R.orders_page(fx.model_orders(raw, with_customer=False), fx.model_payments(raw),
                         fx.model_items(raw), PAGE_LIMIT, PAGE_OFFSET)


# ----------------------------------------------------------------- lookups ---
@query("orders_by_id", """
SELECT k.order_id AS requested_id, o.id IS NOT NULL AS found,
       CASE WHEN o.id IS NULL THEN 'Order not found' END AS error,
       o.tracking_id, o.customer_email, o.customer_name, o.status AS order_status,
       o.metadata_priority, o.created_at, o.updated_at, o.fulfilled_at
FROM (SELECT DISTINCT order_id FROM m_keys) k LEFT JOIN m_orders_full o ON o.id = k.order_id""")
def orders_by_id(raw):
    """Key-set order lookup with not-found rows."""
    return R.orders_by_id(fx.model_orders(raw), fx.lookup_keys(raw))


@query("orders_by_tracking", """
SELECT k.tracking_id AS requested_tracking_id, o.id IS NOT NULL AS found, o.id AS order_id,
       o.customer_email, o.status AS order_status, o.created_at
FROM (SELECT DISTINCT tracking_id FROM m_keys) k
LEFT JOIN (SELECT * FROM m_orders
           QUALIFY row_number() OVER (PARTITION BY tracking_id ORDER BY created_at DESC, id DESC) = 1) o
  ON o.tracking_id = k.tracking_id""")
def orders_by_tracking(raw):
    """Lookup by tracking id, last writer wins."""
    return R.orders_by_tracking(fx.model_orders(raw, with_customer=False), fx.lookup_keys(raw))


@query("payment_status", """
SELECT k.order_id, o.tracking_id,
       CASE WHEN o.id IS NOT NULL THEN coalesce(p.status, '') END AS payment_status,
       o.status AS order_status,
       CASE WHEN o.id IS NOT NULL THEN coalesce(p.amount, 0) END AS amount,
       CASE WHEN o.id IS NOT NULL THEN coalesce(p.currency, '') END AS currency,
       o.created_at, o.updated_at, o.id IS NOT NULL AS found
FROM (SELECT DISTINCT order_id FROM m_keys) k
LEFT JOIN m_orders_full o ON o.id = k.order_id
LEFT JOIN m_payments p ON p.order_id = o.id""")
def payment_status(raw):
    """Status projection for requested orders."""
    return R.payment_status(fx.model_orders(raw, with_customer=False), fx.model_payments(raw),
                            fx.lookup_keys(raw))


CUSTOMER_EMAILS_SQL = ("(SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' "
                       "AS customer_email FROM customer)")


def customer_emails(raw):
    return raw.customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("customer_email"))


@query("customer_orders", f"""
SELECT e.customer_email, coalesce(n.total_orders, 0) AS total_orders, o.id AS order_id,
       o.status AS order_status, o.created_at
FROM {CUSTOMER_EMAILS_SQL} e
LEFT JOIN (SELECT customer_email_at_creation AS customer_email, count(*) AS total_orders
           FROM m_orders GROUP BY 1) n ON n.customer_email = e.customer_email
LEFT JOIN m_orders o ON o.customer_email_at_creation = e.customer_email""")
def customer_orders(raw):
    """Every customer's order history, newest first, with total_orders."""
    return R.customer_orders(fx.model_orders(raw, with_customer=False), customer_emails(raw))


@query("assemble_orders", """
SELECT o.id AS order_id, CAST(i.rn - 1 AS INTEGER) AS pos, i.product_id, i.product_name, i.file_type,
       i.price, i.quantity, i.download_url
FROM m_orders o
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY order_id
             ORDER BY line_no, product_id, product_name, file_type, price, quantity) AS rn
           FROM m_items) i ON i.order_id = o.id""")
def assemble_orders(raw):
    """Flat tables -> nested documents -> exploded back (round trip)."""
    nested = R.assemble_orders(fx.model_orders(raw), fx.model_items(raw), fx.model_payments(raw))
    return R.explode_orders(nested)


PAGE_CURSOR = ("2001-07-01 00:00:00", "ORD100")


@query("orders_page_after", f"""
SELECT o.id, o.tracking_id, o.customer_email,
       CAST(coalesce(p.amount, 0) AS DOUBLE) / 100.0 AS total_amount, o.status,
       coalesce(n.item_count, 0) AS item_count, o.created_at
FROM m_orders o
LEFT JOIN m_payments p ON p.order_id = o.id
LEFT JOIN (SELECT order_id, count(*) AS item_count FROM m_items GROUP BY order_id) n ON n.order_id = o.id
WHERE o.created_at < TIMESTAMP '{PAGE_CURSOR[0]}'
   OR (o.created_at = TIMESTAMP '{PAGE_CURSOR[0]}' AND o.id > '{PAGE_CURSOR[1]}')
ORDER BY o.created_at DESC, o.id ASC LIMIT {PAGE_LIMIT}""")
def orders_page_after(raw):
    """O1, keyset form: the 25 orders after a (created_at, id) cursor."""
    return R.orders_page_after(fx.model_orders(raw, with_customer=False), fx.model_payments(raw),
                               fx.model_items(raw), *PAGE_CURSOR, limit=PAGE_LIMIT)
