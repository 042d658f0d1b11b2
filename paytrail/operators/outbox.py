"""Notification outbox (re-aimed mail builders) and download links.

One row per notice instead of an HTML mail; the body's data fields are
columns.  Who gets which notice is by order status (the reference's mailer is
never called, so the rule is ours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.functions.money import money_text
from paytrail.functions.text import long_date_text, tracking_url
from paytrail.schemas import DOWNLOAD_PENDING_TEXT, NOTICE_BY_STATUS


def with_download_links(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with ``download_link``: the product's URL, or the placeholder text
    when the product is unknown or its URL is empty (products keyed by id)."""
    p = products.select(F.col("id").alias("product_id"), F.col("download_url").alias("product_url"))
    link = F.when(F.coalesce(F.col("product_url"), F.lit("")) != "", F.col("product_url")) \
        .otherwise(F.lit(DOWNLOAD_PENDING_TEXT))
    return items.join(p, "product_id", "left").withColumn("download_link", link).drop("product_url")


def item_download_links(items: DataFrame, products: DataFrame) -> DataFrame:
    """Product id -> download URL per order item."""
    return with_download_links(items.select("order_id", "line_no", "product_id"), products)


def _notices(orders: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    subject_prefix = F.lit(None).cast("string")
    for status, (k, prefix) in reversed(list(NOTICE_BY_STATUS.items())):
        kind = F.when(F.col("status") == status, F.lit(k)).otherwise(kind)
        subject_prefix = F.when(F.col("status") == status, F.lit(prefix)).otherwise(subject_prefix)
    return orders.filter(F.col("status").isin(*NOTICE_BY_STATUS.keys())).select(
        "id", "tracking_id", "customer_email", "customer_name", "status", "created_at",
        kind.alias("kind"), subject_prefix.alias("subject_prefix"))


def notification_outbox(orders: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """One notice per order in a notifiable status (header fields).

    The item lines of each notice are a separate flat table
    (``notification_lines``), so no order's lines are gathered into one row;
    ``n_lines`` is a partial + final count.
    """
    o = _notices(orders)
    amt = payments.select(F.col("order_id").alias("id"), "amount")
    n = items.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
    j = o.join(amt, "id", "left").join(n, "id", "left")
    return j.select(
        "kind", F.col("id").alias("order_id"), F.col("customer_email").alias("recipient"),
        F.concat(F.col("subject_prefix"), F.col("tracking_id")).alias("subject"),
        tracking_url(F.col("tracking_id")).alias("tracking_url"),
        "customer_name",
        money_text(F.coalesce(F.col("amount"), F.lit(0))).alias("amount_text"),
        long_date_text(F.col("created_at")).alias("date_text"),
        F.coalesce(F.col("n_lines"), F.lit(0)).alias("n_lines"))


def notification_lines(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """N1 body lines: one row per item of each notice; fulfilment notices
    carry the download link (or the placeholder text)."""
    o = _notices(orders).select(F.col("id").alias("order_id"), "kind")
    it = with_download_links(
        items.select("order_id", "line_no", "product_id", "product_name", "file_type", "price", "quantity"), products)
    j = it.join(o, "order_id", "inner")
    text = F.concat(F.col("product_name"), F.lit(" ("), F.col("file_type"), F.lit(") x"),
                    F.col("quantity").cast("string"), F.lit(" $"), F.format_string("%.2f", F.col("price")))
    text = F.when(F.col("kind") == "order_fulfillment",
                  F.concat(text, F.lit(" -> "), F.col("download_link"))).otherwise(text)
    return j.select("order_id", "kind", "line_no", "product_id", text.alias("text"))
