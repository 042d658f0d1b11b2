"""Lookup tables by payment id and tracking id.

Each table holds one row a key, the newest order that carries it, with the
order's ``created_at`` beside it, so that a lookup reads no orders.  It is
bucketed and sorted by the key: a join shuffles the asking side alone, into
the table's buckets.  The files carry Bloom filters of the key, so that a
lookup of few keys skips row groups without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.functions.text import or_empty

BUCKETS = 64
KEYS = ("payment_intent_id", "session_id", "tracking_id")


def newest_by(orders: DataFrame, payments: DataFrame, key: str) -> DataFrame:
    """(key, order_id, created_at): the newest order of each non-empty key."""
    o = orders.select(F.col("id").alias("order_id"), "created_at", *(["tracking_id"] if key == "tracking_id" else []))
    rows = o if key == "tracking_id" else payments.select("order_id", key).join(o, "order_id")
    newest = F.max(F.struct("created_at", "order_id")).alias("n")
    return rows.filter(or_empty(F.col(key)) != "").groupBy(key).agg(newest).select(key, "n.order_id", "n.created_at")


def write_lookup(orders: DataFrame, payments: DataFrame, key: str, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the lookup table of ``key`` as ``name`` in the session's catalog, its files under ``path``."""
    rows = newest_by(orders, payments, key)
    # a task writes whole buckets: the shuffle deals by the buckets' own hash
    (rows.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", path)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").bucketBy(buckets, key).sortBy(key).saveAsTable(name))


def lookup(spark: SparkSession, name: str, key: str, asked: DataFrame) -> DataFrame:
    """``asked`` (with a column ``key``) with order_id and created_at; null where no order has the key.

    Only the asking side is shuffled.
    """
    return asked.join(spark.table(name).hint("merge"), key, "left")


def lookup_few(spark: SparkSession, name: str, key: str, keys: list[str]) -> DataFrame:
    """The rows of a handful of keys: a filter that reaches the scan, its buckets and its Bloom filters."""
    return spark.table(name).filter(F.col(key).isin(*keys) if len(keys) != 1 else F.col(key) == keys[0])
