"""Model schemas and enumerations.

Canonical storage is four flat tables (orders, order_items, payments,
payment_events); the nested order document is a derived view
(``operators.reports.assemble_orders``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for right results.
# Order statuses, payment statuses, payment methods, in the reference's order.
ORDER_STATUSES = ["created", "pending", "paid", "fulfilled", "canceled", "refunded"]
PAYMENT_STATUSES = ["pending", "succeeded", "failed", "canceled", "refunded"]
PAYMENT_METHODS = ["card", "paypal", "apple_pay", "google_pay"]
# Provider intent states mapped to payment statuses; anything else -> failed.
PROVIDER_STATUS_MAP = {
    "succeeded": "succeeded",
    "canceled": "canceled",
    "processing": "pending",
    "requires_payment_method": "pending",
    "requires_confirmation": "pending",
    "requires_action": "pending",
}
MAX_WEBHOOK_BYTES = 65536
DEFAULT_PAGE_LIMIT = 50
DEFAULT_CURRENCY = "usd"
DEFAULT_SUCCESS_URL = "https://your-domain.com/success"
DEFAULT_CANCEL_URL = "https://your-domain.com/cancel"
TRACKING_URL_PREFIX = "https://yourdomain.com/track-order?id="
DOWNLOAD_PENDING_TEXT = "Download link will be available shortly"
# Messages of rejected requests and commands.
MSG_BAD_BODY = "Invalid request body"
MSG_NO_EMAIL = "Customer email is required"
MSG_NO_ITEMS = "At least one item is required"
MSG_ORDER_NOT_FOUND = "Order not found"
MSG_NOT_PAID = "Order must be paid before fulfillment"
MSG_NO_INTENT = "No payment intent found for this order"
MSG_EMPTY_ID = "order ID cannot be empty"
# Column length limits of the SQL schema (VARCHAR(n)); DECIMAL(10,2) price.
LENGTH_LIMITS = {
    "orders": {"id": 50, "tracking_id": 50, "customer_email": 255,
               "customer_name": 255, "customer_phone": 50},
    "order_items": {"order_id": 50, "product_id": 50, "product_name": 255, "file_type": 50},
    "payments": {"order_id": 50, "payment_intent_id": 255, "session_id": 255, "currency": 3},
    "payment_events": {"order_id": 50, "event_type": 100},
}
PRICE_MAX_ABS = 10 ** 8  # DECIMAL(10,2): |price| < 10^8
# Mail kinds by order status (our choice; the reference never calls its mailer).
NOTICE_BY_STATUS = {
    "pending": ("order_confirmation", "Order Confirmation - "),
    "paid": ("payment_confirmation", "Payment Confirmed - "),
    "fulfilled": ("order_fulfillment", "Your Order is Ready for Download - "),
    "refunded": ("refund_notification", "Refund Processed - "),
}
# ---------------------------------------------------------------------------

ORDERS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("tracking_id", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_email_at_creation", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
    T.StructField("customer_ip_address", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("fulfilled_at", T.TimestampNTZType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("download_url", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

PAYMENTS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("payment_intent_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("amount", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("processed_at", T.TimestampNTZType()),
    T.StructField("refunded_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

PAYMENT_EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
])

CUSTOMER_INFO = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("ip_address", T.StringType()),
])

REQUEST_ITEM = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
])

ORDER_REQUEST = T.StructType([
    T.StructField("customer_info", CUSTOMER_INFO),
    T.StructField("items", T.ArrayType(REQUEST_ITEM)),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

WEBHOOK_OBJECT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("amount", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("payment_intent", T.StringType()),
    T.StructField("charge", T.StringType()),
    T.StructField("customer_details", T.StructType([
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("phone", T.StringType()),
    ])),
])

WEBHOOK_ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("data", T.StructType([T.StructField("object", WEBHOOK_OBJECT)])),
    T.StructField("_corrupt_record", T.StringType()),
])
