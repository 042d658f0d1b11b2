"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard with
the smallest ``-ln(u) / weight``.  A shard's values never depend on the other
shards, so adding a shard moves records only into it, and a shard's share is its
weight over the sum of weights.  The work is one expression per row.

Slots number a shard's rows without gaps.  A shard is cut into sub-buckets by a
second hash of the key and text, rows are numbered inside a sub-bucket, and the
sub-buckets' counts (shards x sub-buckets rows) give each its first number, so no
task sorts a whole shard.

Defined results: a null text has size 1 and checksum 0; a null key is a key of
its own; rows with equal keys share a shard and have different slots; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.llm.common import pick, shuffle_partitions

LAW = "key"


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard (0-based) of a record key; ``weights`` has one positive number per shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def cost(shard: int, weight: float) -> Column:
        # 53 hash bits, moved off 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    costs = [cost(i, w) for i, w in enumerate(weights)]
    return (costs[0] if len(costs) == 1 else F.least(*costs))["shard"]


def assign(df: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, grown_shard): ``grown`` are the weights after a change of shards."""
    src = pick(df, id_col, text_col)
    key = F.col("id").cast("string")
    return src.select(
        F.col("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumnRenamed("id", id_col)


def with_slots(placed: DataFrame, id_col: str = "doc_id", sub_buckets: int | None = None) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... inside each shard."""
    n = sub_buckets or shuffle_partitions(placed.sparkSession)
    rows = placed.withColumn("__sub", F.pmod(F.xxhash64(id_col, "text_crc32", F.lit("slot")), F.lit(n)).cast("int"))
    counts = rows.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    order = Window.partitionBy("shard", "__sub").orderBy(id_col, "text_crc32", "size")
    return (rows.withColumn("__k", F.row_number().over(order)).join(first, ["shard", "__sub"])
            .withColumn("slot", F.col("__first") + F.col("__k") - 1).drop("__sub", "__k", "__first"))
