"""Queries of declared tables, lookup tables, SQL functions, typed event data and checks while writing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paytrail.operators import events as E
from paytrail.operators import intake as I
from paytrail.operators import quality as D
from paytrail.operators.event_data import MEMBERS, typed_event_data
from paytrail.plans.base import query
from paytrail.plans.oracle import AS_OF
from paytrail.plans.q_events import EVENT_LOG_CTES, PROVIDER_CASE, _webhooks, payment_events
from paytrail.plans.q_quality import NEW_ID_SQL, SQL_TABLE, VALID_REQ_SQL, _tables
from paytrail.plans.sql_functions import register_functions
from paytrail.schemas import LENGTH_LIMITS
from paytrail.session import scratch_path
from paytrail.sources import declared as T
from paytrail.sources import fixtures as fx
from paytrail.sources import lookup as K


# -------------------------------------------------------------- declared tables ---
def _declared(raw, table: str, *batches):
    """A fresh declared table after inserts of these rows; its clock stands at the reports' one."""
    name = f"declared_{table}_{uuid.uuid4().hex[:12]}"
    raw.spark.sql(T.table_ddl(table, name, scratch_path(raw.spark, name), f"TIMESTAMP_NTZ'{fx.AS_OF}'"))
    for rows in batches:
        T.insert(rows, name)
    return raw.spark.table(name)


def _accepted(raw):
    return I.accepted_orders(fx.order_requests(raw))


@query("declared_orders", f"""
SELECT {NEW_ID_SQL} AS id, CASE WHEN r.k % 2 = 0 THEN 'created' END AS status, CASE WHEN r.k % 2 = 0 THEN 0 ELSE 1 END AS n_metadata,
       {AS_OF} AS created_at, {AS_OF} AS updated_at, CAST(NULL AS TIMESTAMP) AS fulfilled_at
FROM {VALID_REQ_SQL} r""")
def declared_orders(raw):
    """D5 by declaration: columns that an insert leaves out take their defaults, a NULL that it names stays."""
    a = _accepted(raw)
    ids = [F.col("order_id").alias("id"), "tracking_id", "customer_email"]
    even, odd = a.filter("request_key % 2 = 0").select(*ids), a.filter("request_key % 2 <> 0").select(*ids, F.lit(None).cast("string").alias("status"), "metadata")
    return _declared(raw, "orders", even, odd).select("id", "status", F.size("metadata").alias("n_metadata"), "created_at", "updated_at", "fulfilled_at")


@query("declared_items", f"""
SELECT 'ORD' || substr(sha256(CAST(o.o_orderkey AS VARCHAR)), 1, 16) AS order_id, i.product_id, CAST(i.price AS DECIMAL(10,2)) AS price,
       CAST(1 AS INTEGER) AS quantity, {AS_OF} AS created_at
FROM orders o JOIN m_items i ON i.order_id = 'ORD' || CAST(o.o_orderkey AS VARCHAR)
WHERE o.o_orderkey % 97 <> 0 AND o.o_orderkey % 53 <> 0""")
def declared_items(raw):
    """D5 by declaration: items without a quantity are one piece; prices are decimals of two places."""
    items = _accepted(raw).select("order_id", F.posexplode("items").alias("pos", "i")).select(
        "order_id", (F.col("pos") + 1).alias("line_no"), "i.product_id", "i.product_name", "i.file_type", F.col("i.price").cast(T.PRICE_TYPE).alias("price"))
    return _declared(raw, "order_items", items).select("order_id", "product_id", "price", "quantity", "created_at")


@query("declared_payments", f"""
SELECT {NEW_ID_SQL} AS order_id, r.cents AS amount, 'usd' AS currency, 'pending' AS status, CASE WHEN r.k % 3 <> 0 THEN 'card' END AS method,
       {AS_OF} AS created_at, {AS_OF} AS updated_at
FROM {VALID_REQ_SQL} r""")
def declared_payments(raw):
    """D5 by declaration: currency, status, method and times of new payments."""
    a = _accepted(raw)
    unnamed = a.filter("request_key % 3 <> 0").select("order_id", "amount")
    named = a.filter("request_key % 3 = 0").select("order_id", "amount", F.lit(None).cast("string").alias("method"))
    return _declared(raw, "payments", unnamed, named).select("order_id", "amount", "currency", "status", "method", "created_at", "updated_at")


@query("declared_events", f"""
SELECT {NEW_ID_SQL} AS order_id, 'order_created' AS event_type, 'pending' AS status, '{{}}' AS data, {AS_OF} AS created_at
FROM {VALID_REQ_SQL} r""")
def declared_events(raw):
    """D5 by declaration: events without data hold an empty object."""
    rows = _accepted(raw).select("order_id", F.lit("order_created").alias("event_type"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("seq"))
    return _declared(raw, "payment_events", rows).select("order_id", "event_type", "status", "data", "created_at")


# ------------------------------------------------------------ checks while writing ---
def _observed_sql() -> str:
    parts = []
    for t, sql in SQL_TABLE.items():
        rules = [("enum", c, f"{c} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in allowed)})") for (x, c), allowed in D.ENUM_RULES.items() if x == t]
        rules += [("required", c, f"{c} IS NULL") for c in D.REQUIRED[t]]
        rules += [("length", c, f"length({c}) > {n}") for c, n in LENGTH_LIMITS[t].items()]
        rules += [("length", "price", "abs(round(price, 2)) >= 100000000")] if t == "order_items" else []
        parts += [f"SELECT '{t}' AS table_name, '{rule}' AS rule, '{c}' AS column_name, count(*) AS checked_rows, count(*) FILTER (WHERE {cond}) AS violations FROM {sql}" for rule, c, cond in rules]
    return EVENT_LOG_CTES + " UNION ALL ".join(parts)


@query("observed_checks", _observed_sql())
def observed_checks(raw):
    """D1, D2, D4 counted in the pass that writes the model: one row a table, rule and column."""
    tables = {t: df.drop("period", "batch") for t, df in _tables(raw).items()}
    rows = []
    for name, df in tables.items():
        seen = T.Observed(df, name)
        seen.frame.write.parquet(scratch_path(raw.spark, f"observed-{name}"))
        rows += seen.violations()
    return raw.spark.createDataFrame(rows, "table_name string, rule string, column_name string, checked_rows bigint, violations bigint")


# ------------------------------------------------------------------- lookup tables ---
def lookup_table(raw, key: str) -> str:
    """The catalog name of the lookup table of ``key``, written once per application and data set."""
    name = f"lookup_{key}_{raw.store.root.rsplit('/', 1)[-1]}"
    if not raw.spark.catalog.tableExists(name):
        K.write_lookup(fx.model_orders(raw, with_customer=False), fx.model_payments(raw), key, name, f"{raw.store.root}/{name}", buckets=8)
    return name


@query("events_to_orders_by_intent_indexed", """
SELECT event_id, kind AS type, object_id, order_id, order_id IS NOT NULL AS matched
FROM m_matched WHERE kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled')""")
def events_to_orders_by_intent_indexed(raw):
    """J3 over the bucketed lookup table: the table is not shuffled and no orders are read."""
    pi = E.route_webhooks(_webhooks(raw)).filter(F.col("type").isin(*E.PI_TYPES)).withColumn("payment_intent_id", F.col("object_id"))
    m = K.lookup(raw.spark, lookup_table(raw, "payment_intent_id"), "payment_intent_id", pi)
    return m.select("event_id", "type", "object_id", "order_id", F.col("order_id").isNotNull().alias("matched"))


@query("events_to_orders_by_session_indexed", """
SELECT w.event_id, w.object_id, w.payment_intent, coalesce(s.order_id, i.order_id) AS order_id,
       CASE WHEN s.order_id IS NOT NULL THEN 'session' WHEN i.order_id IS NOT NULL THEN 'payment_intent' END AS matched_by
FROM m_ok_webhooks w
LEFT JOIN m_session_index s ON s.session_id = w.object_id
LEFT JOIN m_intent_index i ON i.payment_intent_id = w.payment_intent
WHERE w.kind = 'checkout.session.completed'""")
def events_to_orders_by_session_indexed(raw):
    """J4 over the two bucketed lookup tables: by session, else by the session's intent."""
    cs = E.route_webhooks(_webhooks(raw)).filter(F.col("type") == E.CHECKOUT_TYPE).select("event_id", "object_id", "payment_intent")
    by_s = K.lookup(raw.spark, lookup_table(raw, "session_id"), "session_id", cs.withColumn("session_id", F.col("object_id")))
    left = by_s.select("event_id", "object_id", "payment_intent", F.col("order_id").alias("s_order"), F.col("payment_intent").alias("payment_intent_id"))
    both = K.lookup(raw.spark, lookup_table(raw, "payment_intent_id"), "payment_intent_id", left)
    return both.select("event_id", "object_id", "payment_intent", F.coalesce("s_order", "order_id").alias("order_id"),
                       F.when(F.col("s_order").isNotNull(), "session").when(F.col("order_id").isNotNull(), "payment_intent").alias("matched_by"))


@query("orders_by_tracking_indexed", """
SELECT k.tracking_id, o.id IS NOT NULL AS found, o.id AS order_id
FROM (SELECT DISTINCT tracking_id FROM m_keys) k LEFT JOIN m_orders o ON o.tracking_id = k.tracking_id""")
def orders_by_tracking_indexed(raw):
    """P2 over the lookup table: order ids of tracking ids."""
    k = fx.lookup_keys(raw).select("tracking_id").distinct()
    return K.lookup(raw.spark, lookup_table(raw, "tracking_id"), "tracking_id", k).select("tracking_id", F.col("order_id").isNotNull().alias("found"), "order_id")


# ----------------------------------------------------------------------- VARIANT ---
def _member_sql(name: str, cast: str = "") -> str:
    text = f"json_extract_string(data, '$.{name}')"
    return f"CAST(rtrim({text}, 'Z') AS TIMESTAMP) AS {name}" if cast == "time" else f"CAST({text} AS {cast}) AS {name}" if cast else f"{text} AS {name}"


@query("event_data_typed", EVENT_LOG_CTES + "SELECT id, order_id, event_type, " + ", ".join(
    _member_sql(m, {"bigint": "BIGINT", "timestamp": "time"}.get(t, "")) for m, t in MEMBERS.items()) + " FROM elog")
def event_data_typed(raw):
    """ST9 data as VARIANT: the members of all seven kinds of event in their types."""
    return typed_event_data(payment_events(raw))


# ----------------------------------------------------------------- SQL functions ---
@query("sql_functions_report", f"""
, l AS (SELECT order_id, CAST(sum(line_cents) AS BIGINT) AS line_total FROM m_item_cents GROUP BY order_id)
SELECT o.id, coalesce(l.line_total, 0) AS line_total, CAST(coalesce(l.line_total, 0) AS DOUBLE) / 100.0 AS line_dollars,
       printf('%.2f', CAST(coalesce(p.amount, 0) AS DOUBLE) / 100.0) AS amount_text, strftime(o.created_at, '%B %-d, %Y') AS date_text,
       CASE WHEN i.id IS NOT NULL THEN {PROVIDER_CASE} END AS provider_says
FROM m_orders o LEFT JOIN l ON l.order_id = o.id LEFT JOIN m_payments p ON p.order_id = o.id LEFT JOIN m_intents i ON i.id = p.payment_intent_id""")
def sql_functions_report(raw):
    """S1, S2, S4, S7, S13 as SQL functions in one SQL statement over the model."""
    from paytrail.plans.views import register_views
    register_functions(raw.spark)
    register_views(raw.spark, {"orders": fx.model_orders(raw), "order_items": fx.model_items(raw), "payments": fx.model_payments(raw)}, fx.AS_OF)
    fx.model_provider_intents(raw).createOrReplaceTempView("provider_intents")
    return raw.spark.sql("""
        SELECT o.id, coalesce(l.line_total, 0) AS line_total, cents_to_dollars(coalesce(l.line_total, 0)) AS line_dollars,
               money_text(coalesce(p.amount, 0)) AS amount_text, long_date_text(o.created_at) AS date_text,
               CASE WHEN i.id IS NOT NULL THEN map_provider_status(i.status) END AS provider_says
        FROM orders o
        LEFT JOIN (SELECT order_id, sum(line_cents(price, quantity)) AS line_total FROM order_items GROUP BY order_id) l ON l.order_id = o.id
        LEFT JOIN payments p ON p.order_id = o.id
        LEFT JOIN provider_intents i ON i.id = p.payment_intent_id""")


@query("page_parameters", """
, t AS (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-' || CAST(event_id AS VARCHAR) WHEN 2 THEN event_type
               WHEN 3 THEN '' WHEN 4 THEN CAST(event_id AS VARCHAR) || '.5' ELSE '0' END AS text FROM events)
SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CASE WHEN event_id >= 1 THEN CAST(event_id AS INTEGER) ELSE 50 END ELSE 50 END AS page_limit,
       CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CAST(event_id AS INTEGER) ELSE 0 END AS page_offset FROM t""")
def page_parameters(raw):
    """Text parameters as integers with a fallback: limits of 1 or more (else 50), offsets of 0 or more (else 0)."""
    register_functions(raw.spark)
    k, e = F.col("event_id").cast("string"), F.col("event_id") % 6
    text = F.when(e == 0, k).when(e == 1, F.concat(F.lit("-"), k)).when(e == 2, F.col("event_type")).when(e == 3, "").when(e == 4, F.concat(k, F.lit(".5"))).otherwise("0")
    return raw.events.select("event_id", text.alias("text")).selectExpr("event_id", "int_param(text, 50, 1) AS page_limit", "int_param(text, 0, 0) AS page_offset")
