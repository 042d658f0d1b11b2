"""DuckDB oracle SQL for every registered query.

The driver registers only the raw tables, so each statement starts with the
fixture model written as CTEs (the same rules as ``paytrail.sources.fixtures``).
DuckDB evaluates only the CTEs a statement references.

Traps pinned here: DuckDB's ``::BIGINT`` rounds where Go truncates, so money
uses ``trunc``; integer sums are HUGEINT, so they are cast back to BIGINT.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-07-15 12:00:00'"

PRELUDE = f"""
m_orders AS (
  SELECT 'ORD' || CAST(o.o_orderkey AS VARCHAR) AS id,
         'TRK' || CAST(o.o_orderkey AS VARCHAR) AS tracking_id,
         'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS customer_email,
         'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS customer_email_at_creation,
         c.c_name AS customer_name,
         CASE WHEN o.o_custkey % 4 = 0 THEN NULL
              ELSE '555-' || CAST(o.o_custkey % 10000 AS VARCHAR) END AS customer_phone,
         CAST(NULL AS VARCHAR) AS customer_ip_address,
         CASE o.o_orderstatus
           WHEN 'O' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'created' ELSE 'pending' END
           WHEN 'F' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'refunded' ELSE 'fulfilled' END
           WHEN 'P' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'canceled' ELSE 'paid' END
         END AS status,
         o.o_orderpriority AS metadata_priority,
         CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderdate
              ELSE o.o_orderdate + to_seconds(o.o_orderkey % 86400) END AS created_at,
         o.o_orderkey AS okey
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
),
m_orders_full AS (
  SELECT *, created_at AS updated_at,
         CASE WHEN status = 'fulfilled' THEN created_at + INTERVAL 1 DAY END AS fulfilled_at
  FROM m_orders
),
m_payments AS (
  SELECT 'ORD' || CAST(o.o_orderkey AS VARCHAR) AS order_id,
         'pi_' || CAST(o.o_orderkey AS VARCHAR) AS payment_intent_id,
         CASE WHEN o.o_orderkey % 3 = 0 THEN 'cs_' || CAST(o.o_orderkey AS VARCHAR) END AS session_id,
         CAST(trunc(o.o_totalprice * 100) AS BIGINT) AS amount,
         'usd' AS currency,
         CASE o.o_orderstatus
           WHEN 'O' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'pending'
                              WHEN o.o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'pending' END
           WHEN 'F' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'refunded' ELSE 'succeeded' END
           WHEN 'P' THEN CASE WHEN o.o_orderpriority = '5-LOW' THEN 'canceled' ELSE 'succeeded' END
         END AS status,
         'card' AS method,
         o.o_orderkey AS okey,
         CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderdate
              ELSE o.o_orderdate + to_seconds(o.o_orderkey % 86400) END AS created_at
  FROM orders o WHERE o.o_orderkey % 10 <> 9
),
m_payments_full AS (
  SELECT order_id, payment_intent_id, session_id, amount, currency, status, method,
         CASE WHEN status IN ('succeeded', 'refunded') THEN created_at + INTERVAL 1 HOUR END AS processed_at,
         CAST(NULL AS TIMESTAMP) AS refunded_at, created_at, created_at AS updated_at
  FROM m_payments
),
m_items AS (
  SELECT 'ORD' || CAST(l.l_orderkey AS VARCHAR) AS order_id,
         l.l_linenumber AS line_no,
         'prod_' || CAST(l.l_partkey AS VARCHAR) AS product_id,
         p.p_name AS product_name,
         p.p_type AS file_type,
         CAST((l.l_partkey * 7) % 2000 + 99 AS DOUBLE) / 100.0 AS price,
         CASE WHEN l.l_linenumber = 7 THEN 0 ELSE CAST(l.l_quantity AS INTEGER) END AS quantity,
         CAST(NULL AS VARCHAR) AS download_url,
         l.l_shipdate AS created_at
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
),
m_item_cents AS (
  SELECT *, CAST(trunc(price * CAST(100 AS DOUBLE)
                 * CAST(CASE WHEN quantity <= 0 THEN 1 ELSE quantity END AS DOUBLE)) AS BIGINT) AS line_cents
  FROM m_items
),
m_products AS (
  SELECT 'prod_' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description,
         'https://cdn.example.com/img/' || CAST(p_partkey AS VARCHAR) || '.png' AS image_1,
         p_brand AS brand, (p_size % 4 <> 0) AS active,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE 'https://files.example.com/dl/' || CAST(p_partkey AS VARCHAR) END
           AS download_url
  FROM part
),
m_intents AS (
  SELECT 'pi_' || CAST(o_orderkey AS VARCHAR) AS id,
         (['succeeded', 'canceled', 'processing', 'requires_payment_method', 'requires_confirmation',
           'requires_action', 'requires_capture'])[CAST(o_orderkey % 7 AS INTEGER) + 1] AS status,
         CAST(trunc(o_totalprice * 100) AS BIGINT) AS amount
  FROM orders WHERE o_orderkey % 10 <> 9
),
m_keys AS (
  SELECT 'ORD' || CAST(c_custkey * 11 AS VARCHAR) AS order_id,
         'TRK' || CAST(c_custkey * 11 AS VARCHAR) AS tracking_id,
         'pi_' || CAST(c_custkey * 11 AS VARCHAR) AS payment_intent_id,
         'prod_' || CAST(c_custkey * 3 AS VARCHAR) AS product_id
  FROM customer
),
m_feed AS (
  SELECT event_id, ts, user_id, value,
         CASE WHEN event_type = 'purchase' THEN 'payment_intent.succeeded'
              WHEN event_type = 'error' THEN 'payment_intent.payment_failed'
              WHEN event_type = 'click' AND value < 60 THEN 'payment_intent.canceled'
              WHEN event_type = 'click' THEN 'command.refund'
              WHEN event_type = 'signup' THEN 'command.fulfill'
              WHEN event_type = 'view' AND value < 20 THEN 'checkout.session.completed'
              WHEN event_type = 'view' AND value < 60 THEN 'charge.dispute.created'
              WHEN event_type = 'view' AND value < 100 THEN 'invoice.payment_succeeded'
              ELSE 'customer.created' END AS kind
  FROM events
),
m_webhooks AS (
  SELECT event_id, ts, user_id, kind,
         CASE WHEN event_id % 997 = 0 THEN 'payload_too_large'
              WHEN event_id % 101 = 0 THEN 'unreadable_payload' END AS reject_reason,
         'evt_' || CAST(event_id AS VARCHAR) AS envelope_id,
         CASE WHEN kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') THEN 'pi_' || CAST(user_id AS VARCHAR)
              WHEN kind = 'checkout.session.completed' THEN 'cs_' || CAST(user_id AS VARCHAR)
              WHEN kind = 'invoice.payment_succeeded' THEN 'in_' || CAST(event_id AS VARCHAR)
              WHEN kind = 'charge.dispute.created' THEN 'dp_' || CAST(event_id AS VARCHAR)
              ELSE 'cus_' || CAST(user_id AS VARCHAR) END AS object_id,
         CASE WHEN kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') THEN CAST(trunc(value * 100) AS BIGINT) END AS amount,
         CASE WHEN kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') THEN 'usd' END AS currency,
         CASE WHEN kind = 'checkout.session.completed' THEN 'pi_' || CAST(user_id AS VARCHAR) END AS payment_intent,
         CASE WHEN kind = 'charge.dispute.created' THEN 'ch_' || CAST(user_id AS VARCHAR) END AS charge,
         (kind = 'checkout.session.completed' AND event_id % 5 <> 0) AS has_customer_details,
         CASE WHEN kind = 'checkout.session.completed' AND event_id % 5 <> 0 THEN
           CASE WHEN event_id % 7 = 0 THEN ''
                ELSE 'u' || CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 3 AS VARCHAR) || '@example.com' END
         END AS customer_email,
         CASE WHEN kind = 'checkout.session.completed' AND event_id % 5 <> 0 THEN
           CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Buyer ' || CAST(event_id AS VARCHAR) END
         END AS customer_name,
         CASE WHEN kind = 'checkout.session.completed' AND event_id % 5 <> 0 THEN
           CASE WHEN event_id % 3 = 0 THEN '' ELSE '555-' || CAST(event_id AS VARCHAR) END
         END AS customer_phone
  FROM m_feed WHERE kind NOT LIKE 'command.%'
),
m_ok_webhooks AS (SELECT * FROM m_webhooks WHERE reject_reason IS NULL),
m_commands AS (
  SELECT event_id, ts, 'ORD' || CAST(user_id AS VARCHAR) AS order_id,
         split_part(kind, '.', 2) AS command
  FROM m_feed WHERE kind LIKE 'command.%'
),
m_intent_index AS (
  SELECT payment_intent_id, arg_max(p.order_id, o.created_at || '|' || p.order_id) AS order_id
  FROM m_payments p JOIN m_orders o ON o.id = p.order_id
  WHERE coalesce(payment_intent_id, '') <> ''
  GROUP BY payment_intent_id
),
m_session_index AS (
  SELECT session_id, arg_max(p.order_id, o.created_at || '|' || p.order_id) AS order_id
  FROM m_payments p JOIN m_orders o ON o.id = p.order_id
  WHERE coalesce(session_id, '') <> ''
  GROUP BY session_id
),
m_matched AS (
  SELECT w.*,
         CASE WHEN w.kind = 'checkout.session.completed' THEN coalesce(s.order_id, i2.order_id)
              WHEN w.kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') THEN i.order_id END AS order_id
  FROM m_ok_webhooks w
  LEFT JOIN m_intent_index i ON w.kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') AND i.payment_intent_id = w.object_id
  LEFT JOIN m_session_index s ON w.kind = 'checkout.session.completed' AND s.session_id = w.object_id
  LEFT JOIN m_intent_index i2 ON w.kind = 'checkout.session.completed' AND i2.payment_intent_id = w.payment_intent
),
m_ops AS (
  SELECT order_id, ts, event_id,
         CASE kind WHEN 'payment_intent.succeeded' THEN 'succeeded'
                   WHEN 'payment_intent.payment_failed' THEN 'failed'
                   WHEN 'payment_intent.canceled' THEN 'canceled'
                   ELSE 'checkout' END AS op,
         CASE WHEN kind = 'checkout.session.completed' THEN payment_intent END AS set_intent
  FROM m_matched
  WHERE order_id IS NOT NULL
    AND kind IN ('payment_intent.succeeded', 'payment_intent.payment_failed',
                 'payment_intent.canceled', 'checkout.session.completed')
  UNION ALL
  SELECT c.order_id, c.ts, c.event_id, c.command AS op, CAST(NULL AS VARCHAR) AS set_intent
  FROM m_commands c WHERE c.order_id IN (SELECT id FROM m_orders)
),
m_ops_guarded AS (
  SELECT o.*,
         (coalesce(p.payment_intent_id, '') <> ''
          OR EXISTS (SELECT 1 FROM m_ops x WHERE x.order_id = o.order_id AND x.op = 'checkout'
                     AND coalesce(x.set_intent, '') <> ''
                     AND (x.ts < o.ts OR (x.ts = o.ts AND x.event_id < o.event_id)))) AS intent_ok
  FROM m_ops o LEFT JOIN m_payments p ON p.order_id = o.order_id
)
"""


def q(body: str) -> str:
    return f"WITH {PRELUDE} {body}"


ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    ORACLE[name] = q(body)
