"""Data-quality, outbox and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paytrail.operators import intake as I
from paytrail.operators import outbox as N
from paytrail.operators import quality as D
from paytrail.operators import reports as R
from paytrail.plans.base import query
from paytrail.plans.oracle import AS_OF
from paytrail.plans.q_events import CHECKOUT_CTES, EVENT_LOG_CTES, _batch, payment_events
from paytrail.schemas import LENGTH_LIMITS
from paytrail.sources import fixtures as fx
from paytrail.sources import eventlog as L
from paytrail.sources import sinks as S

SQL_TABLE = {"orders": "m_orders", "order_items": "m_items", "payments": "m_payments", "payment_events": "elog"}


MODEL = {"orders": fx.model_orders, "order_items": fx.model_items, "payments": fx.model_payments, "payment_events": payment_events}


def _tables(raw, *names):
    """The model tables that a query names (all without names); others are not built for it."""
    return {t: MODEL[t](raw) for t in MODEL if not names or t in names}


def _enum_sql() -> str:
    parts = []
    for (table, column), allowed in D.ENUM_RULES.items():
        vals = ", ".join(f"'{v}'" for v in allowed)
        parts.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS checked_rows, "
                     f"count(*) FILTER (WHERE {column} IS NOT NULL AND {column} NOT IN ({vals})) AS invalid_rows "
                     f"FROM {SQL_TABLE[table]}")
    return EVENT_LOG_CTES + " UNION ALL ".join(parts)


@query("check_enums", _enum_sql())
def check_enums(raw):
    """Enum membership of statuses and methods."""
    return D.check_enums(_tables(raw, *(t for t, _ in D.ENUM_RULES)))


def _required_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count "
             f"FROM {SQL_TABLE[t]}" for t, cols in D.REQUIRED.items() for c in cols]
    return EVENT_LOG_CTES + " UNION ALL ".join(parts)


@query("check_required", _required_sql())
def check_required(raw):
    """NOT NULL violations per column."""
    return D.check_required(_tables(raw))


def _unique_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE n > 1) AS duplicate_keys, "
             f"CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows "
             f"FROM (SELECT {c}, count(*) AS n FROM {SQL_TABLE[t]} WHERE {c} IS NOT NULL GROUP BY {c})"
             for t, c in D.UNIQUE]
    return ", unused AS (SELECT 1) " + " UNION ALL ".join(parts)


@query("check_unique", _unique_sql())
def check_unique(raw):
    """D3: duplicate order ids, tracking ids and payments per order."""
    return D.check_unique(_tables(raw, *(t for t, _ in D.UNIQUE)))


def _lengths_sql() -> str:
    parts = []
    for t, limits in LENGTH_LIMITS.items():
        for c, n in limits.items():
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({n} AS INTEGER) AS max_allowed, "
                         f"count(*) FILTER (WHERE length({c}) > {n}) AS too_long, "
                         f"CAST(coalesce(max(length({c})), 0) AS INTEGER) AS max_length FROM {SQL_TABLE[t]}")
    parts.append("SELECT 'order_items', 'price', 10, count(*) FILTER (WHERE abs(round(price, 2)) >= 100000000), CAST(NULL AS INTEGER) FROM m_items")
    return EVENT_LOG_CTES + " UNION ALL ".join(parts)


@query("check_lengths", _lengths_sql())
def check_lengths(raw):
    """VARCHAR(n) and DECIMAL(10,2) overflow."""
    return D.check_lengths(_tables(raw))


VALID_REQ_SQL = """(SELECT o.o_orderkey AS k, o.o_custkey AS custkey, n.cents
  FROM orders o JOIN (SELECT order_id, CAST(sum(line_cents) AS BIGINT) AS cents FROM m_item_cents GROUP BY order_id) n
    ON n.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR)
  WHERE o.o_orderkey % 97 <> 0 AND o.o_orderkey % 53 <> 0)"""
NEW_ID_SQL = "'ORD' || substr(sha256(CAST(r.k AS VARCHAR)), 1, 16)"


def _intake_rows(raw):
    """Accepted requests as new order rows with their payment; omitted columns NULL."""
    a = I.accepted_orders(fx.order_requests(raw))
    return a.select(F.col("order_id").alias("id"), "customer_email", "metadata",
                    F.lit(None).cast("string").alias("status"),
                    F.lit(None).cast("timestamp_ntz").alias("created_at"),
                    F.lit(None).cast("timestamp_ntz").alias("updated_at"),
                    "amount", F.lit(None).cast("string").alias("currency"),
                    F.lit(None).cast("string").alias("payment_status"), F.lit(None).cast("string").alias("method"))


@query("apply_defaults", f"""
SELECT {NEW_ID_SQL} AS id, 'created' AS status, 1 AS n_metadata, {AS_OF} AS created_at, {AS_OF} AS updated_at,
       r.cents AS amount, 'usd' AS currency, 'pending' AS payment_status, 'card' AS method
FROM {VALID_REQ_SQL} r""")
def apply_defaults(raw):
    """Schema defaults for omitted columns of newly taken orders."""
    d = D.payment_defaults(D.order_defaults(_intake_rows(raw), fx.AS_OF), "payment_status")
    return d.select("id", "status", F.size("metadata").alias("n_metadata"), "created_at", "updated_at",
                    "amount", "currency", "payment_status", "method")


@query("check_foreign_keys", EVENT_LOG_CTES + """
SELECT 'order_items' AS table_name, count(*) AS checked_rows, count(*) FILTER (WHERE o.id IS NULL) AS orphan_rows
FROM m_items c LEFT JOIN m_orders o ON o.id = c.order_id
UNION ALL
SELECT 'payments', count(*), count(*) FILTER (WHERE o.id IS NULL)
FROM m_payments c LEFT JOIN m_orders o ON o.id = c.order_id
UNION ALL
SELECT 'payment_events', count(*), count(*) FILTER (WHERE o.id IS NULL)
FROM elog c LEFT JOIN m_orders o ON o.id = c.order_id""")
def check_foreign_keys(raw):
    """Children without an order (one report)."""
    t = _tables(raw)
    return D.check_foreign_keys(t["orders"], {k: t[k] for k in ("order_items", "payments", "payment_events")})


@query("cascade_delete", EVENT_LOG_CTES + """
, gone AS (SELECT id FROM m_orders WHERE status = 'canceled')
SELECT 'order_items' AS table_name, count(*) FILTER (WHERE d.id IS NULL) AS kept_rows,
       count(*) FILTER (WHERE d.id IS NOT NULL) AS deleted_rows
FROM m_items c LEFT JOIN gone d ON d.id = c.order_id
UNION ALL
SELECT 'payments', count(*) FILTER (WHERE d.id IS NULL), count(*) FILTER (WHERE d.id IS NOT NULL)
FROM m_payments c LEFT JOIN gone d ON d.id = c.order_id
UNION ALL
SELECT 'payment_events', count(*) FILTER (WHERE d.id IS NULL), count(*) FILTER (WHERE d.id IS NOT NULL)
FROM elog c LEFT JOIN gone d ON d.id = c.order_id""")
def cascade_delete(raw):
    """Deleting canceled orders removes their items, payments and events."""
    t = _tables(raw)
    gone = t["orders"].filter(F.col("status") == "canceled").select("id")
    return D.cascade_summary(gone, {k: t[k] for k in ("order_items", "payments", "payment_events")})


@query("cascade_survivors", EVENT_LOG_CTES + """
, gone AS (SELECT id FROM m_orders WHERE status = 'canceled')
SELECT 'order_items' AS table_name, order_id, CAST(line_no AS VARCHAR) AS row_key FROM m_items
WHERE order_id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'payments', order_id, payment_intent_id FROM m_payments WHERE order_id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'payment_events', order_id, id FROM elog WHERE order_id NOT IN (SELECT id FROM gone)""")
def cascade_survivors(raw):
    """The item, payment and event rows that remain after canceled orders are deleted."""
    t = _tables(raw)
    gone = t["orders"].filter(F.col("status") == "canceled").select("id")
    keys = {"order_items": F.col("line_no").cast("string"), "payments": F.col("payment_intent_id"), "payment_events": F.col("id")}
    left = D.cascade_delete(gone, {k: t[k] for k in keys})
    rows = [left[k].select(F.lit(k).alias("table_name"), "order_id", c.alias("row_key")) for k, c in keys.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ------------------------------------------------------------------- outbox ---
NOTICE_CASE = """CASE o.status WHEN 'pending' THEN 'order_confirmation' WHEN 'paid' THEN 'payment_confirmation'
  WHEN 'fulfilled' THEN 'order_fulfillment' WHEN 'refunded' THEN 'refund_notification' END"""
SUBJECT_CASE = """CASE o.status WHEN 'pending' THEN 'Order Confirmation - ' WHEN 'paid' THEN 'Payment Confirmed - '
  WHEN 'fulfilled' THEN 'Your Order is Ready for Download - ' WHEN 'refunded' THEN 'Refund Processed - ' END"""
LINK_SQL = ("CASE WHEN coalesce(p.download_url, '') <> '' THEN p.download_url "
            "ELSE 'Download link will be available shortly' END")


@query("notification_outbox", f"""
SELECT {NOTICE_CASE} AS kind, o.id AS order_id, o.customer_email AS recipient,
       {SUBJECT_CASE} || o.tracking_id AS subject,
       'https://yourdomain.com/track-order?id=' || o.tracking_id AS tracking_url, o.customer_name,
       printf('%.2f', CAST(coalesce(pm.amount, 0) AS DOUBLE) / 100.0) AS amount_text,
       strftime(o.created_at, '%B %-d, %Y') AS date_text,
       CAST(coalesce(l.n_lines, 0) AS INTEGER) AS n_lines
FROM m_orders o LEFT JOIN m_payments pm ON pm.order_id = o.id
LEFT JOIN (SELECT order_id, count(*) AS n_lines FROM m_items GROUP BY order_id) l ON l.order_id = o.id
WHERE o.status IN ('pending', 'paid', 'fulfilled', 'refunded')""")
def notification_outbox(raw):
    """One notice per order (confirmation / payment / fulfilment / refund)."""
    return N.notification_outbox(fx.model_orders(raw), fx.model_payments(raw), fx.model_items(raw))


@query("notification_lines", f"""
SELECT i.order_id, {NOTICE_CASE} AS kind, i.line_no, i.product_id,
       i.product_name || ' (' || i.file_type || ') x' || CAST(i.quantity AS VARCHAR) || ' $' || printf('%.2f', i.price)
         || CASE WHEN o.status = 'fulfilled' THEN ' -> ' || {LINK_SQL} ELSE '' END AS text
FROM m_items i JOIN m_orders o ON o.id = i.order_id LEFT JOIN m_products p ON p.id = i.product_id
WHERE o.status IN ('pending', 'paid', 'fulfilled', 'refunded')""")
def notification_lines(raw):
    """N1 body: one row per item line of each notice (download links on fulfilment)."""
    return N.notification_lines(fx.model_orders(raw, with_customer=False), fx.model_items(raw),
                                fx.model_products(raw))


@query("item_download_links", f"""
SELECT i.order_id, i.line_no, i.product_id, {LINK_SQL} AS download_link
FROM m_items i LEFT JOIN m_products p ON p.id = i.product_id""")
def item_download_links(raw):
    """Download link per order item, placeholder when absent."""
    return N.item_download_links(fx.model_items(raw), fx.model_products(raw))


# -------------------------------------------------------------------- sinks ---
@query("event_log_append", EVENT_LOG_CTES + f"""
SELECT * FROM elog
UNION ALL
SELECT 'evt_' || substr(sha256('order_created|' || {NEW_ID_SQL} || '|0'), 1, 24), {NEW_ID_SQL},
       'order_created', 'pending', '{{"payment_intent_id":"' || i.id || '"}}', {AS_OF}, CAST(0 AS BIGINT)
FROM {VALID_REQ_SQL} r JOIN m_intents i ON i.id = 'pi_' || CAST(r.k AS VARCHAR)""")
def event_log_append(raw):
    """IO4: a second batch appended to the stored log, the creation events of new orders.

    The service logs a creation once the provider has made the intent, with its id; an order without one is not logged.
    """
    from paytrail.session import scratch_path
    path = scratch_path(raw.spark, "event-log")
    L.append_events(payment_events(raw), path, 0, L.MONTH)
    intents = fx.model_provider_intents(raw).select(F.substring("id", len("pi_") + 1, 40).cast("long").alias("request_key"), F.col("id").alias("payment_intent_id"))
    L.append_events(S.prepare_append(I.creation_events(I.accepted_orders(fx.order_requests(raw)), intents), fx.AS_OF), path, 1, L.MONTH)
    return L.read_events(raw.spark, path).drop("period", "batch")


@query("order_upsert", CHECKOUT_CTES.replace("SELECT u.order_id, CASE", ", ck AS (SELECT u.order_id, CASE", 1)
       .rstrip() + f""")
SELECT o.id,
       CASE WHEN ck.order_id IS NOT NULL THEN ck.customer_email ELSE o.customer_email END AS customer_email,
       CASE WHEN ck.order_id IS NOT NULL THEN ck.customer_name ELSE o.customer_name END AS customer_name,
       CASE WHEN ck.order_id IS NOT NULL THEN ck.customer_phone ELSE o.customer_phone END AS customer_phone,
       o.status, o.created_at,
       CASE WHEN ck.order_id IS NOT NULL THEN ck.updated_at ELSE o.updated_at END AS updated_at,
       CASE WHEN ck.order_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
FROM m_orders_full o LEFT JOIN ck ON ck.order_id = o.id
UNION ALL
SELECT {NEW_ID_SQL}, 'c' || CAST(r.custkey AS VARCHAR) || '@example.com', NULL, NULL, 'created',
       {AS_OF}, {AS_OF}, 'inserted'
FROM {VALID_REQ_SQL} r""")
def order_upsert(raw):
    """IO5: orders after checkout updates (latest wins) and new orders from intake."""
    from paytrail.operators.events import apply_checkout_completed
    b = _batch(raw)
    base = fx.model_orders(raw).select("id", "customer_email", "customer_name", "customer_phone", "status",
                                       "created_at", "updated_at")
    upd = apply_checkout_completed(b.matched, fx.model_orders(raw), b.payments).select(
        F.col("order_id").alias("id"), "customer_email", "customer_name", "customer_phone", "updated_at",
        F.lit(1).alias("seq"))
    a = I.accepted_orders(fx.order_requests(raw))
    now = F.lit(fx.AS_OF).cast("timestamp_ntz")
    ins = a.select(F.col("order_id").alias("id"), F.lit(0).alias("seq"), "customer_email", F.lit(None).cast("string").alias("customer_name"),
                   F.lit(None).cast("string").alias("customer_phone"), F.lit("created").alias("status"),
                   now.alias("created_at"), now.alias("updated_at"))
    snapshot, _rejects = S.order_upsert(base, upd, ins)
    return snapshot


@query("order_upsert_rejects", """
SELECT DISTINCT order_id AS id, 'update' AS operation, 'order not found' AS reason
FROM m_keys WHERE order_id NOT IN (SELECT id FROM m_orders)""")
def order_upsert_rejects(raw):
    """IO5: what an upsert refuses: here status updates by looked-up ids, of which some orders are not stored."""
    base = fx.model_orders(raw, with_customer=False).select("id", "status", "updated_at")
    upd = fx.lookup_keys(raw).select(F.col("order_id").alias("id"), F.lit("canceled").alias("status"),
                                     F.lit(fx.AS_OF).cast("timestamp_ntz").alias("updated_at"), F.lit(1).alias("seq"))
    return S.order_upsert(base, upd, base.limit(0).withColumn("seq", F.lit(0)))[1]


# changes of the looked-up orders, some of which are not stored: an update, a whole row and another update, in an order
# that differs from order to order
_MIXED_SQL = """
, ch AS (
  SELECT order_id AS id, 3 * (c % 7) AS seq, 'u' AS kind, 'paid' AS status FROM keyed
  UNION ALL SELECT order_id, 3 * (c % 5) + 1, 'i', 'created' FROM keyed WHERE c % 2 = 0
  UNION ALL SELECT order_id, 3 * (c % 3) + 5, 'u', 'canceled' FROM keyed WHERE c % 4 = 0),
seen AS (
  SELECT ch.*, o.id IS NOT NULL OR bool_or(kind = 'i') OVER (PARTITION BY ch.id ORDER BY seq) AS there,
         max(CASE WHEN kind = 'i' THEN seq END) OVER (PARTITION BY ch.id) AS last_row
  FROM ch LEFT JOIN m_orders o ON o.id = ch.id),
fin AS (
  SELECT id, arg_max(status, seq) AS status, bool_or(kind = 'i') AS replaced
  FROM seen WHERE there AND (last_row IS NULL OR seq >= last_row) GROUP BY id)
"""
_KEYED_SQL = ", keyed AS (SELECT DISTINCT order_id, CAST(substr(order_id, 4) AS BIGINT) // 11 AS c FROM m_keys)" + _MIXED_SQL


def _mixed(raw):
    c = (F.substring("order_id", 4, 20).cast("long") / 11).cast("long")
    k = fx.lookup_keys(raw).select("order_id", c.alias("c")).distinct()
    base = fx.model_orders(raw, with_customer=False).select("id", "status")
    upd = (k.select(F.col("order_id").alias("id"), F.lit("paid").alias("status"), (F.col("c") % 7 * 3).alias("seq"))
           .unionByName(k.filter("c % 4 = 0").select(F.col("order_id").alias("id"), F.lit("canceled").alias("status"), (F.col("c") % 3 * 3 + 5).alias("seq"))))
    ins = k.filter("c % 2 = 0").select(F.col("order_id").alias("id"), F.lit("created").alias("status"), (F.col("c") % 5 * 3 + 1).alias("seq"))
    return S.order_upsert(base, upd, ins)


@query("order_upsert_interleaved", _KEYED_SQL + """
SELECT o.id, coalesce(f.status, o.status) AS status,
       CASE WHEN f.id IS NULL THEN 'kept' WHEN x.n > 0 THEN 'replaced' ELSE 'updated' END AS change
FROM m_orders o LEFT JOIN fin f ON f.id = o.id LEFT JOIN (SELECT id, count(*) FILTER (WHERE kind = 'i') AS n FROM ch GROUP BY id) x ON x.id = o.id
UNION ALL
SELECT id, status, 'inserted' FROM fin WHERE id NOT IN (SELECT id FROM m_orders)""")
def order_upsert_interleaved(raw):
    """IO5: whole rows and updates of the same orders apply in the order of ``seq``."""
    return _mixed(raw)[0]


@query("order_upsert_interleaved_rejects", _KEYED_SQL + """
SELECT DISTINCT id, 'update' AS operation, 'order not found' AS reason FROM seen WHERE NOT there""")
def order_upsert_interleaved_rejects(raw):
    """IO5: an update before its order's first row is refused, also where a whole row follows."""
    return _mixed(raw)[1]


def _key(name: str, value: str) -> str:
    """SQL text of a JSON member that is left out when empty."""
    return f"""CASE WHEN coalesce({value}, '') <> '' THEN ',"{name}":' || CAST(to_json({value}) AS VARCHAR) ELSE '' END"""


def _ts(name: str, value: str) -> str:
    return (f"""CASE WHEN {value} IS NOT NULL THEN ',"{name}":"' || """
            f"""rtrim(rtrim(strftime({value}, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z"' ELSE '' END""")


def _text(value: str) -> str:
    return f"CAST(to_json(coalesce({value}, '')) AS VARCHAR)"


@query("order_documents", f"""
, li AS (
  SELECT order_id, string_agg('{{"product_id":' || {_text('product_id')} || ',"product_name":' || {_text('product_name')}
           || ',"file_type":' || {_text('file_type')} || ',"price":' || CAST(price AS VARCHAR)
           || ',"quantity":' || CAST(quantity AS VARCHAR) || {_key('download_url', 'download_url')} || '}}',
           ',' ORDER BY line_no, product_id, product_name, file_type, price, quantity) AS lines
  FROM m_items GROUP BY order_id),
pay AS (
  SELECT o.id AS order_id,
         {_key(S.DOC_INTENT_KEY, 'p.payment_intent_id')} || {_key(S.DOC_SESSION_KEY, 'p.session_id')}
         || ',"amount":' || CAST(coalesce(p.amount, 0) AS VARCHAR) || ',"currency":' || {_text('p.currency')}
         || ',"status":' || {_text('p.status')} || {_key('method', 'p.method')}
         || {_ts('processed_at', 'p.processed_at')} || {_ts('refunded_at', 'p.refunded_at')} AS members
  FROM m_orders o LEFT JOIN m_payments_full p ON p.order_id = o.id)
SELECT o.id, '{{"id":' || {_text('o.id')} || ',"tracking_id":' || {_text('o.tracking_id')}
       || ',"customer_info":{{"email":' || {_text('o.customer_email')} || {_key('name', 'o.customer_name')}
       || {_key('phone', 'o.customer_phone')} || {_key('ip_address', 'o.customer_ip_address')}
       || '}},"items":[' || coalesce(li.lines, '') || '],"payment":{{' || substr(pay.members, 2)
       || '}},"status":' || {_text('o.status')}
       || ',"metadata":{{"priority":' || {_text('o.metadata_priority')} || '}}'
       || {_ts('created_at', 'o.created_at')} || {_ts('updated_at', 'o.updated_at')}
       || {_ts('fulfilled_at', 'o.fulfilled_at')} || '}}' AS document
FROM m_orders_full o JOIN pay ON pay.order_id = o.id LEFT JOIN li ON li.order_id = o.id""")
def order_documents(raw):
    """IO6: nested JSON order documents with the service's keys and omitempty rules."""
    nested = R.assemble_orders(fx.model_orders(raw), fx.model_items(raw), fx.model_payments(raw))
    return S.order_documents(nested)


@query("order_documents_roundtrip", """
SELECT o.id, o.customer_email AS email, coalesce(o.customer_name, '') <> '' AS has_name,
       coalesce(o.customer_phone, '') <> '' AS has_phone, coalesce(n.n, 0) AS n_items,
       coalesce(p.amount, 0) AS payment_amount, coalesce(p.status, '') AS payment_status,
       coalesce(p.payment_intent_id, '') <> '' AS has_intent, o.metadata_priority IS NOT NULL AS has_metadata,
       o.fulfilled_at IS NOT NULL AS has_fulfilled_at, o.status
FROM m_orders_full o
LEFT JOIN m_payments p ON p.order_id = o.id
LEFT JOIN (SELECT order_id, CAST(count(*) AS INTEGER) AS n FROM m_items GROUP BY order_id) n ON n.order_id = o.id""")
def order_documents_roundtrip(raw):
    """IO6 checked: fields read back from the JSON documents (omitempty keys
    absent, required keys present even when empty)."""
    d = order_documents(raw)
    doc = F.col("document")

    def has(path):
        return F.get_json_object(doc, path).isNotNull()
    return d.select(
        "id", F.get_json_object(doc, "$.customer_info.email").alias("email"),
        has("$.customer_info.name").alias("has_name"), has("$.customer_info.phone").alias("has_phone"),
        F.json_array_length(F.get_json_object(doc, "$.items")).alias("n_items"),
        F.get_json_object(doc, "$.payment.amount").cast("long").alias("payment_amount"),
        F.get_json_object(doc, "$.payment.status").alias("payment_status"),
        has(f"$.payment.{S.DOC_INTENT_KEY}").alias("has_intent"), has("$.metadata").alias("has_metadata"),
        has("$.fulfilled_at").alias("has_fulfilled_at"), F.get_json_object(doc, "$.status").alias("status"))
