"""Sinks: event-log append, order upsert with snapshot swap, JSON documents.

There is no MERGE-capable table format in this build, so an upsert writes a
whole new snapshot directory and then swaps a small pointer file; readers
always see either the old or the new snapshot, and a retried job writes to a
fresh directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.functions import ids
from paytrail.functions.text import null_if_empty
from paytrail.schemas import MSG_EMPTY_ID

POINTER = "_CURRENT"
# fixed keys of the payment ids in an order document
DOC_INTENT_KEY = "stripe_payment_intent_id"
DOC_SESSION_KEY = "stripe_session_id"


# --------------------------------------------------------------------- IO4 ---
def prepare_append(new_events: DataFrame, as_of) -> DataFrame:
    """Assign ids to events without one and stamp the append time."""
    stamp = F.lit(str(as_of)).cast("timestamp_ntz")
    return new_events.select(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "",
               ids.event_id(F.col("event_type"), F.col("order_id"), F.col("seq"))).otherwise(F.col("id")).alias("id"),
        "order_id", "event_type", "status", F.coalesce(F.col("data"), F.lit("{}")).alias("data"),
        stamp.alias("created_at"), "seq")


def event_log_append(log: DataFrame, new_events: DataFrame, as_of) -> DataFrame:
    """IO4 (batch form): the log after appending ``new_events``."""
    return log.unionByName(prepare_append(new_events, as_of))


# --------------------------------------------------------------------- IO5 ---
def order_upsert(base: DataFrame, updates: DataFrame, inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``inserts`` (whole rows + seq) and ``updates`` (id + changed columns + seq) to ``base`` in the order of ``seq``.

    A whole row replaces the row of its id, and only updates after the last
    whole row count; of these the latest wins.  ``seq`` is unique within an id
    (an insert comes before an update of the same ``seq``).  An empty id is
    rejected, and so is an update while its id is neither stored nor inserted
    yet.  One grouped pass by id over all three.  Returns (snapshot, rejects);
    ``change`` is kept, updated, replaced or inserted.
    """
    for name, df in (("updates", updates), ("inserts", inserts)):
        if "seq" not in df.columns:
            raise ValueError(f"{name} need a column seq: the order in which changes apply")
    upd_cols = [c for c in updates.columns if c not in ("id", "seq")]
    row, delta = F.struct(*base.columns), F.struct(*upd_cols)
    seq = F.col("seq").cast("long")
    empty = F.coalesce(F.col("id"), F.lit("")) == ""
    schema_of = base.select(row.alias("r")).schema["r"].dataType
    none_row, none_delta = F.lit(None).cast(schema_of), F.lit(None).cast(updates.select(delta.alias("r")).schema["r"].dataType)
    changes = (base.select("id", F.lit("base").alias("kind"), F.lit(None).cast("long").alias("seq"), row.alias("r"), none_delta.alias("u"))
               .unionByName(inserts.filter(~empty).select("id", F.lit("insert").alias("kind"), seq.alias("seq"),
                                                          row.cast(schema_of).alias("r"), none_delta.alias("u")))
               .unionByName(updates.select("id", F.lit("update").alias("kind"), seq.alias("seq"), none_row.alias("r"), delta.alias("u"))))
    kind = F.col("kind")
    inserted, updated = F.when(kind == "insert", F.col("seq")), F.when(kind == "update", F.col("seq"))
    g = changes.groupBy("id").agg(
        F.first(F.when(kind == "base", F.col("r")), ignorenulls=True).alias("b"),
        F.max_by("r", inserted).alias("i"), F.min(inserted).alias("first_insert"), F.max(inserted).alias("last_insert"),
        F.max_by("u", updated).alias("u"), F.min(updated).alias("first_update"), F.max(updated).alias("last_update"))
    known = F.col("b").isNotNull() | F.col("i").isNotNull()
    # the latest update counts if it comes after the last whole row
    changed = F.col("last_update").isNotNull() & (F.col("last_insert").isNull() | (F.col("last_update") >= F.col("last_insert")))
    whole = F.coalesce(F.col("i"), F.col("b"))
    snapshot = g.filter(known).select(
        "id",
        *[F.when(changed, F.col(f"u.{c}")).otherwise(whole[c]).alias(c) if c in upd_cols else whole[c].alias(c) for c in base.columns if c != "id"],
        F.when(F.col("b").isNull(), F.lit("inserted")).when(F.col("i").isNotNull(), F.lit("replaced"))
        .when(changed, F.lit("updated")).otherwise(F.lit("kept")).alias("change"))
    early = F.col("b").isNull() & F.col("first_update").isNotNull() & (F.col("first_insert").isNull() | (F.col("first_update") < F.col("first_insert")))
    rejects = (inserts.filter(empty).select("id", F.lit("insert").alias("operation"), F.lit(MSG_EMPTY_ID).alias("reason"))
               .unionByName(g.filter(early).select("id", F.lit("update").alias("operation"), F.lit("order not found").alias("reason"))))
    return snapshot, rejects


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap_small(spark: SparkSession, path: str, text: str) -> None:
    """Replace the one-line file ``path``: a reader finds the old line or the new one, never none."""
    fs, ptr = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(ptr.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, ptr, options)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The line of ``path``; None where there is no such file."""
    fs, ptr = _fs(spark, path)
    if not fs.exists(ptr):
        return None
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(ptr)))
    line = reader.readLine()
    reader.close()
    return line


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new snapshot directory under ``root`` and swap the pointer."""
    target = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    swap_small(df.sparkSession, f"{root.rstrip('/')}/{POINTER}", target)
    return target


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(read_small(spark, f"{root.rstrip('/')}/{POINTER}"))


# --------------------------------------------------------------------- IO6 ---
def rfc3339(ts: Column) -> Column:
    """A UTC timestamp as RFC 3339 text: fraction without trailing zeros, zone Z."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def order_documents(nested: DataFrame) -> DataFrame:
    """Nested orders -> JSON documents with the service's keys and ``omitempty`` rules.

    Empty optional strings, an empty metadata map and unset timestamps are
    left out; required fields stay even when empty (a missing payment is
    written as amount 0 with empty currency and status).
    """
    ci = F.col("customer_info")
    customer = F.struct(F.coalesce(ci["email"], F.lit("")).alias("email"),
                        null_if_empty(ci["name"]).alias("name"), null_if_empty(ci["phone"]).alias("phone"),
                        null_if_empty(ci["ip_address"]).alias("ip_address"))
    items = F.transform("items", lambda x: F.struct(
        x["product_id"].alias("product_id"), x["product_name"].alias("product_name"),
        x["file_type"].alias("file_type"), x["price"].alias("price"), x["quantity"].alias("quantity"),
        null_if_empty(x["download_url"]).alias("download_url")))
    pm = F.col("payment")
    payment = F.struct(
        null_if_empty(pm["payment_intent_id"]).alias(DOC_INTENT_KEY),
        null_if_empty(pm["session_id"]).alias(DOC_SESSION_KEY),
        F.coalesce(pm["amount"], F.lit(0).cast("long")).alias("amount"),
        F.coalesce(pm["currency"], F.lit("")).alias("currency"),
        F.coalesce(pm["status"], F.lit("")).alias("status"),
        null_if_empty(pm["method"]).alias("method"),
        rfc3339(pm["processed_at"]).alias("processed_at"), rfc3339(pm["refunded_at"]).alias("refunded_at"))
    meta = F.when(F.size(F.coalesce(F.col("metadata"), F.create_map())) > 0, F.col("metadata"))
    doc = F.struct(F.col("id"), F.col("tracking_id"), customer.alias("customer_info"), items.alias("items"),
                   payment.alias("payment"), F.col("status"), meta.alias("metadata"),
                   *[rfc3339(F.col(c)).alias(c) for c in ("created_at", "updated_at", "fulfilled_at")])
    return nested.select("id", F.to_json(doc).alias("document"))
