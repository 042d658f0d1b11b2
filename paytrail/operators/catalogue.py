"""Provider catalogue lookups re-aimed as tables: intents and products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.operators.broadcast import broadcast_if_small


def _product_cols(p: DataFrame) -> DataFrame:
    return p.select("id", "name", "description",
                    F.col("images").getItem(0).alias("image_1"), F.size("images").alias("n_images"),
                    F.col("metadata").getItem("brand").alias("brand"))


def active_products(products: DataFrame) -> DataFrame:
    """Every active product, five fields (images/metadata flattened).

    The reference's ``limit`` only sets the provider's page size while its
    iterator walks all pages, so no row cap applies here.
    """
    return _product_cols(products.filter(F.col("active")))


def products_by_id(products: DataFrame, keys: DataFrame) -> DataFrame:
    """Key-set product lookup; unmatched ids are reported."""
    k = keys.select(F.col("product_id").alias("id")).distinct()
    hit = _product_cols(products.join(broadcast_if_small(k), "id", "left_semi"))
    return k.join(hit.withColumn("found", F.lit(True)), "id", "left").select(
        F.col("id").alias("requested_id"), F.coalesce("found", F.lit(False)).alias("found"),
        "name", "description", "image_1", "n_images", "brand")


def verify_payment(intents: DataFrame, keys: DataFrame) -> DataFrame:
    """Provider intent by id -> id, status, amount."""
    k = keys.select(F.col("payment_intent_id").alias("id")).distinct()
    hit = intents.select("id", "status", "amount").join(broadcast_if_small(k), "id", "left_semi")
    return k.join(hit.withColumn("found", F.lit(True)), "id", "left").select(
        F.col("id").alias("requested_id"), F.coalesce("found", F.lit(False)).alias("found"), "status", "amount")
