"""Order intake: decode JSON requests, validate, price, and build the
payment-intent outbox.

Totals are computed on each request's own item array with the higher-order
``aggregate`` function: no shuffle and no per-order grouping is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.functions import ids
from paytrail.functions.money import effective_quantity, line_cents
from paytrail.functions.text import or_empty
from paytrail.schemas import (DEFAULT_CANCEL_URL, DEFAULT_CURRENCY, DEFAULT_SUCCESS_URL, MSG_BAD_BODY,
                              MSG_NO_EMAIL, MSG_NO_ITEMS, ORDER_REQUEST)

REASON_BAD_BODY, REASON_NO_EMAIL, REASON_NO_ITEMS = MSG_BAD_BODY, MSG_NO_EMAIL, MSG_NO_ITEMS


def decode_order_requests(requests: DataFrame, payload_col: str = "payload") -> DataFrame:
    """IO2: JSON text -> request struct; undecodable text keeps ``_corrupt_record``."""
    parsed = F.from_json(F.col(payload_col), ORDER_REQUEST,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return requests.withColumn("req", parsed).withColumn(
        "decoded", F.col("req").isNotNull() & F.col("req._corrupt_record").isNull())


def order_requests_ingest(requests: DataFrame) -> DataFrame:
    d = decode_order_requests(requests)
    return d.select(
        "request_key", "decoded",
        F.when(F.col("decoded"), F.col("req.customer_info.email")).alias("customer_email"),
        F.when(F.col("decoded"), F.coalesce(F.size("req.items"), F.lit(0))).alias("item_count"),
        F.when(F.col("decoded"), F.col("req.metadata").getItem("priority")).alias("metadata_priority"),
    )


def rejection_reason(decoded: Column, email: Column, items: Column) -> Column:
    """First failing rule wins (decode, email, items)."""
    return (F.when(~decoded, F.lit(REASON_BAD_BODY))
            .when(or_empty(email) == "", F.lit(REASON_NO_EMAIL))
            .when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(REASON_NO_ITEMS)))


def validate_order_requests(requests: DataFrame) -> DataFrame:
    d = decode_order_requests(requests)
    reason = rejection_reason(F.col("decoded"), F.col("req.customer_info.email"), F.col("req.items"))
    return d.select("request_key", reason.isNull().alias("valid"), reason.alias("reason"))


def request_total_cents(items: Column, rounding: str = "parity") -> Column:
    """S2 + A4 on the nested item array."""
    return F.aggregate(items, F.lit(0).cast("long"),
                       lambda acc, x: acc + line_cents(x["price"], x["quantity"], rounding))


def accepted_orders(requests: DataFrame) -> DataFrame:
    """Valid requests as new orders with deterministic ids and their totals."""
    d = decode_order_requests(requests)
    reason = rejection_reason(F.col("decoded"), F.col("req.customer_info.email"), F.col("req.items"))
    ok = d.filter(reason.isNull())
    return ok.select(
        "request_key",
        ids.order_id(F.col("request_key")).alias("order_id"),
        ids.tracking_id(F.col("request_key")).alias("tracking_id"),
        F.col("req.customer_info.email").alias("customer_email"),
        F.col("req.customer_info.name").alias("customer_name"),
        F.col("req.customer_info.phone").alias("customer_phone"),
        F.col("req.customer_info.ip_address").alias("customer_ip_address"),
        F.col("req.metadata").alias("metadata"),
        F.col("req.items").alias("items"),
        request_total_cents(F.col("req.items")).alias("amount"),
        F.size("req.items").alias("item_count"),
    )


def stored_rows(accepted: DataFrame, as_of) -> dict[str, DataFrame]:
    """``accepted_orders`` as rows of the orders, order_items and payments tables.

    A new order is ``created`` and its payment ``pending`` without an intent.
    Lines keep their place in the request; a quantity of zero or less is one.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    no_time, no_text = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    orders = accepted.select(
        F.col("order_id").alias("id"), "tracking_id", "customer_email",
        F.col("customer_email").alias("customer_email_at_creation"), "customer_name", "customer_phone",
        "customer_ip_address", F.lit("created").alias("status"), "metadata", now.alias("created_at"),
        now.alias("updated_at"), no_time.alias("fulfilled_at"))
    items = accepted.select("order_id", F.posexplode("items").alias("pos", "i")).select(
        "order_id", (F.col("pos") + 1).alias("line_no"), "i.product_id", "i.product_name", "i.file_type", "i.price",
        effective_quantity(F.col("i.quantity")).alias("quantity"), no_text.alias("download_url"), now.alias("created_at"))
    payments = accepted.select(
        "order_id", no_text.alias("payment_intent_id"), no_text.alias("session_id"), "amount",
        F.lit(DEFAULT_CURRENCY).alias("currency"), F.lit("pending").alias("status"), F.lit("card").alias("method"),
        no_time.alias("processed_at"), no_time.alias("refunded_at"), now.alias("created_at"), now.alias("updated_at"))
    return {"orders": orders, "order_items": items, "payments": payments}


def creation_events(accepted: DataFrame, intents: DataFrame) -> DataFrame:
    """Log rows of new orders whose intent the provider has made: ``intents`` (request_key, payment_intent_id).

    Ids are left empty; the append assigns them.
    """
    made = accepted.select("request_key", "order_id").join(intents, "request_key")
    return made.select(F.lit("").alias("id"), "order_id", F.lit("order_created").alias("event_type"), F.lit("pending").alias("status"),
                       F.to_json(F.struct("payment_intent_id")).alias("data"), F.lit(0).cast("long").alias("seq"))


def payment_intent_requests(requests: DataFrame) -> DataFrame:
    """The outbox of intents to create for accepted orders."""
    o = accepted_orders(requests)
    meta = F.create_map(F.lit("order_id"), F.col("order_id"), F.lit("tracking_id"), F.col("tracking_id"),
                        F.lit("customer_email"), F.col("customer_email"))
    return o.select("request_key", "order_id", "tracking_id", "amount",
                    F.lit(DEFAULT_CURRENCY).alias("currency"), meta.alias("metadata"))


def _default(c: Column, value: str) -> Column:
    return F.when(or_empty(c) == "", F.lit(value)).otherwise(c)


def provider_request_defaults(intent_requests: DataFrame, checkout_requests: DataFrame) -> DataFrame:
    """Legacy provider requests with the service's defaults filled in.

    Intent requests: currency defaults to usd, metadata copied when present.
    Checkout requests: currency usd, success/cancel URLs, one line of
    quantity 1, payment method list ["card"].  Both kinds in one table.
    """
    intents = intent_requests.select(
        F.lit("payment_intent").alias("request_kind"), "ref", F.lit(None).cast("int").alias("line_no"),
        F.col("description").alias("name"), "amount", _default(F.col("currency"), DEFAULT_CURRENCY).alias("currency"),
        F.lit(None).cast("string").alias("success_url"), F.lit(None).cast("string").alias("cancel_url"),
        F.lit(None).cast("long").alias("quantity"), F.lit(None).cast("array<string>").alias("method_types"),
        F.col("metadata"))
    checkouts = checkout_requests.select(
        F.lit("checkout_session").alias("request_kind"), "ref", "line_no",
        F.col("product_name").alias("name"), "amount", _default(F.col("currency"), DEFAULT_CURRENCY).alias("currency"),
        _default(F.col("success_url"), DEFAULT_SUCCESS_URL).alias("success_url"),
        _default(F.col("cancel_url"), DEFAULT_CANCEL_URL).alias("cancel_url"),
        F.lit(1).cast("long").alias("quantity"), F.array(F.lit("card")).alias("method_types"),
        F.lit(None).cast("map<string,string>").alias("metadata"))
    return intents.unionByName(checkouts)
