"""The webhook and command feed as Structured Streaming queries.

Four queries, each with its own checkpoint and a plain Parquet sink:

* ``webhooks`` -- raw deliveries (text lines) decoded under the size cap,
                  optionally without redeliveries inside the watermark;
* ``rejects``  -- deliveries that are too large or unreadable, with a reason;
* ``matched``  -- state-changing webhooks with the order of their payment ids
                  (``MatchOrders``, by bucket of the id);
* ``decisions``-- what every webhook and command did to its order
                  (``OrderSegments``, by bucket of order and segment of time).

Order state, checkout updates, event log and dead letter are read from the
state store and the sinks with the batch operators.  A delivery is one line:
arrival number, arrival time and body, separated by tabs; the body comes last
and may hold anything but a line end.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.functions.text import or_empty
from paytrail.operators import events as E
from paytrail.operators.fold import STATE_COLUMNS, FoldResult
from paytrail.session import ship_package
from paytrail.streaming.state import CARRIED, DECISIONS, MATCHED, MATCHES, MatchOrders, OrderSegments, bucket, checkout_rows, compose, pack, segment_summaries, unpack

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEGMENT_SECONDS = 86_400
# tasks that one payment id's webhooks are dealt to; claims go to all of them
SALTS = 8
WATERMARK = "3 days"
COMMANDS = "event_id bigint, ts timestamp_ntz, order_id string, command string"
WEBHOOKS = MATCHED.split(", order_id")[0]
REJECTS = "event_id bigint, ts timestamp_ntz, reject_reason string"


# ------------------------------------------------------------- raw deliveries ---
def delivery_lines(payloads: DataFrame) -> DataFrame:
    """(event_id, ts, payload) as the text lines that a receiver appends to its landing files."""
    return payloads.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "payload").alias("value"))


def parse_deliveries(lines: DataFrame) -> DataFrame:
    """Text lines -> (event_id, ts, payload).  Only the first two tabs separate."""
    part = F.split("value", "\t", 3)
    return lines.select(F.get(part, F.lit(0)).try_cast("bigint").alias("event_id"), F.get(part, F.lit(1)).try_cast("timestamp_ntz").alias("ts"),
                        F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("payload"))


def read_deliveries(spark: SparkSession, source: str, max_bytes: int | None = None) -> DataFrame:
    """The raw stream; ``max_bytes`` bounds what one micro-batch reads."""
    reader = spark.readStream
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes))
    return parse_deliveries(reader.text(source))


def without_redeliveries(webhooks: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The first delivery of each envelope id; a later one is dropped while the watermark has not passed it by.

    Webhooks without an envelope id are all kept.
    """
    key = F.coalesce("envelope_id", F.concat(F.lit("feed_"), F.col("event_id").cast("string")))
    # the watermark needs a time with a zone
    keyed = webhooks.withColumn("delivery_key", key).withColumn("arrived", F.col("ts").cast("timestamp"))
    return keyed.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["delivery_key"]).drop("delivery_key", "arrived")


# -------------------------------------------------------------------- matching ---
def _index(orders: DataFrame, payments: DataFrame, key: str, other: str) -> DataFrame:
    """key -> newest order that carries it, with the order's other payment id."""
    o = orders.select(F.col("id").alias("order_id"), "created_at")
    p = payments.select("order_id", key, other).filter(or_empty(F.col(key)) != "")
    newest = F.max(F.struct("created_at", "order_id", other)).alias("n")
    return p.join(o, "order_id").groupBy(key).agg(newest).select(key, F.col("n.order_id").alias("order_id"), F.col("n.created_at").alias("created_at"), F.col(f"n.{other}").alias(other))


def match_rows(routed: DataFrame, orders: DataFrame, payments: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows for ``MatchOrders``: every webhook at its payment id, and what its checkout changes at other ids."""
    by_intent = _index(orders, payments, "payment_intent_id", "session_id").toDF("i_key", "i_order", "i_created", "i_session")
    by_session = _index(orders, payments, "session_id", "payment_intent_id").toDF("s_key", "s_order", "s_created", "s_intent")
    t = F.col("type")
    checkout = t == E.CHECKOUT_TYPE
    r = routed.filter(t.isin(*E.PI_TYPES) | checkout)
    r = (r.withColumn("i_id", F.when(checkout, F.col("payment_intent")).otherwise(F.col("object_id"))).withColumn("s_id", F.when(checkout, F.col("object_id")))
         .join(by_intent, F.col("i_id") == F.col("i_key"), "left").join(by_session, F.col("s_id") == F.col("s_key"), "left"))
    i_id, s_id = or_empty(F.col("i_id")), or_empty(F.col("s_id"))
    order, created = F.coalesce("s_order", "i_order"), F.coalesce("s_created", "i_created")
    old_intent = F.when(F.col("s_order").isNotNull(), F.col("s_intent")).otherwise(F.col("i_id"))
    old_session = F.when(F.col("s_order").isNotNull(), F.col("s_id")).otherwise(F.col("i_session"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    here = F.array(F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))

    def row(kind: str, key: Column, when: Column, salt: Column, index_order: Column, index_created: Column, session_order: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("id"), salt.alias("salts"), index_order.alias("index_order"),
                                     index_created.alias("index_created"), session_order.alias("session_order")))

    none = F.lit(None).cast("string")
    known = checkout & order.isNotNull()
    by_i = i_id != ""
    rows = F.array_compact(F.array(
        row("event", F.when(by_i, F.concat(F.lit("i:"), i_id)).otherwise(F.concat(F.lit("s:"), s_id)), F.lit(True), here,
            F.when(by_i, F.col("i_order")).otherwise(F.col("s_order")), F.when(by_i, F.col("i_created")).otherwise(F.col("s_created")), F.col("s_order")),
        row("claim", F.concat(F.lit("i:"), i_id), known & by_i, every, order, created, none),
        row("claim", F.concat(F.lit("s:"), s_id), known & (s_id != ""), every, order, created, none),
        row("release", F.concat(F.lit("i:"), old_intent), known & by_i & (or_empty(old_intent) != "") & (old_intent != i_id), every, order, created, none),
        row("release", F.concat(F.lit("s:"), old_session), known & (or_empty(old_session) != "") & (old_session != s_id), every, order, created, none)))
    out = r.select(*CARRIED, F.explode(rows).alias("m")).select(*CARRIED, "m.*")
    return out.select("*", F.explode("salts").alias("salt")).drop("salts")


# ------------------------------------------------------------------- the stream ---
class OrderStream:
    """The four queries over a landing folder of deliveries and a folder of commands, onto stored order rows.

    ``root`` takes the sinks and checkpoints.  ``partitions`` is the number of state partitions, fixed at the first start.
    """

    def __init__(self, orders: DataFrame, payments: DataFrame, deliveries: str, commands: str, root: str, segment_seconds: int = SEGMENT_SECONDS,
                 dedup: bool = False, max_bytes: int | None = None, partitions: int | None = None):
        self.spark, self.orders, self.payments = orders.sparkSession, orders, payments
        self.deliveries, self.commands_path, self.root = deliveries, commands, root.rstrip("/")
        self.segment_seconds, self.dedup, self.max_bytes = segment_seconds, dedup, max_bytes
        self.partitions = partitions

    def path(self, sink: str) -> str:
        return f"{self.root}/{sink}"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/_checkpoints/{query}"

    def _sink(self, df: DataFrame, name: str, available_now: bool, trigger: str):
        writer = df.writeStream.format("parquet").outputMode("append").option("path", self.path(name)).option("checkpointLocation", self.checkpoint(name)).queryName(f"{name} of {self.root}")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
        with _state_settings(self.spark, self.partitions):
            return writer.start()

    def start_webhooks(self, available_now: bool = False, trigger: str = "10 seconds"):
        ok = E.webhook_ingest(read_deliveries(self.spark, self.deliveries, self.max_bytes)).filter("reject_reason is null").drop("reject_reason", "charge")
        return self._sink((without_redeliveries(ok) if self.dedup else ok).select(*CARRIED), "webhooks", available_now, trigger)

    def start_rejects(self, available_now: bool = False, trigger: str = "10 seconds"):
        bad = E.webhook_ingest(read_deliveries(self.spark, self.deliveries, self.max_bytes)).filter("reject_reason is not null")
        return self._sink(bad.select("event_id", "ts", "reject_reason"), "rejects", available_now, trigger)

    def start_matched(self, available_now: bool = False, trigger: str = "10 seconds"):
        ship_package(self.spark)
        webhooks = self.spark.readStream.schema(WEBHOOKS).parquet(self.path("webhooks"))
        rows = match_rows(webhooks, self.orders, self.payments)
        matched = pack(rows).withColumn("bucket", bucket("id", "salt")).groupBy("bucket").transformWithState(MatchOrders(), outputStructType=MATCHES, outputMode="Append", timeMode="None")
        return self._sink(unpack(matched), "matched", available_now, trigger)

    def start_decisions(self, available_now: bool = False, trigger: str = "10 seconds"):
        ship_package(self.spark)
        matched = self.spark.readStream.schema(MATCHED).parquet(self.path("matched"))
        detail = ("has_customer_details", "customer_email", "customer_name", "customer_phone", "object_id")
        ops = E.webhook_ops(matched, *detail).select("order_id", "ts", "event_id", "op", "set_intent", *detail)
        commands = self.spark.readStream.schema(COMMANDS).parquet(self.commands_path)
        known = commands.join(self.orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        kinds = dict(ops.dtypes)
        mine = known.select("order_id", "ts", "event_id", F.col("command").alias("op"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("set_intent", *detail)])
        segment = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / self.segment_seconds).alias("seg")
        rows = ops.unionByName(mine).select("*", segment)
        decided = rows.withColumn("bucket", bucket("order_id", "seg")).groupBy("bucket").transformWithState(OrderSegments(), outputStructType=DECISIONS, outputMode="Append", timeMode="None")
        return self._sink(decided, "decisions", available_now, trigger)

    def _folders(self) -> None:
        """The folders that the queries watch, where they are not there yet."""
        for sink, schema in (("webhooks", WEBHOOKS), ("matched", MATCHED)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(sink))

    def start(self, trigger: str = "10 seconds") -> list:
        """All four queries, running until stopped."""
        self._folders()
        return [f(False, trigger) for f in (self.start_webhooks, self.start_rejects, self.start_matched, self.start_decisions)]

    def run_available(self) -> None:
        """Process what has arrived, query by query, and stop."""
        self._folders()
        for f in (self.start_webhooks, self.start_rejects, self.start_matched, self.start_decisions):
            f(True).awaitTermination()

    # -- results --
    def summaries(self) -> DataFrame:
        """(order_id, seg, s) as the state store holds them."""
        s = self.spark.read.format("statestore").option("path", self.checkpoint("decisions")).option("stateVarName", "summary").load()
        return s.select(F.explode(segment_summaries(F.col("user_map_value.entries"))).alias("e")).select("e.*")

    def composed(self) -> DataFrame:
        return compose(self.summaries(), self.orders, self.payments)

    def state(self) -> DataFrame:
        """One row of ``STATE_COLUMNS`` per order with events."""
        return self.composed().select(*STATE_COLUMNS)

    def checkouts(self) -> DataFrame:
        """Customer details and payment ids of the orders with a checkout."""
        return checkout_rows(self.composed(), self.orders, self.payments)

    def matched(self) -> DataFrame:
        return self.spark.read.schema(MATCHED).parquet(self.path("matched"))

    def webhooks(self) -> DataFrame:
        """Decoded webhooks and rejects, in the columns that the dead letter reads."""
        ok = self.spark.read.schema(WEBHOOKS).parquet(self.path("webhooks")).withColumn("reject_reason", F.lit(None).cast("string"))
        bad = self.spark.read.schema(REJECTS).parquet(self.path("rejects"))
        return ok.unionByName(bad, allowMissingColumns=True)

    def commands(self) -> DataFrame:
        return self.spark.read.schema(COMMANDS).parquet(self.commands_path)

    def decisions(self) -> DataFrame:
        """(order_id, ts, event_id, op, accepted): every webhook and command with the outcome of the case its segment was entered in."""
        cases = self.composed().select("order_id", F.explode("cases").alias("c")).select("order_id", "c.seg", "c.case")
        d = self.spark.read.schema(DECISIONS).parquet(self.path("decisions"))
        return d.join(cases, ["order_id", "seg"]).select("order_id", "ts", "event_id", "op", F.element_at("accepted", F.col("case")).alias("accepted"))

    def event_log(self, include_created: bool = False) -> DataFrame:
        """The event log rows of everything that was applied."""
        d = self.decisions()
        fulfills = d.filter("op = 'fulfill'").select("order_id", "ts", "event_id", "accepted")
        refunds = d.filter("op = 'refund'").withColumnRenamed("accepted", "intent_ok")
        return E.event_log(self.matched(), FoldResult(None, fulfills, None), refunds, self.orders, self.payments, include_created)

    def dead_letter(self) -> DataFrame:
        return E.dead_letter(self.webhooks(), self.matched(), self.commands(), self.orders)


@contextmanager
def _state_settings(spark: SparkSession, partitions: int | None):
    """The state store's settings while a query starts, which takes a copy of the session's; then the user's again."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slices(parts: int, *tables: DataFrame) -> list[list[DataFrame]]:
    """``tables`` (with ``ts``) cut into ``parts`` slices of time, the same for all of them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    every = tables[0].select("ts")
    for t in tables[1:]:
        every = every.unionByName(t.select("ts"))
    span = every.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    lo, hi = span.lo or 0, span.hi or 0
    piece = F.least(F.floor((micros - lo) * parts / (hi - lo + 1)), F.lit(parts - 1))
    return [[t.filter(piece == i) for t in tables] for i in range(parts)]


def replay(payloads: DataFrame, commands: DataFrame, orders: DataFrame, payments: DataFrame, work_root: str, parts: int = 3, **settings) -> OrderStream:
    """Replay a feed as a live stream: slices of time, each written into the landing folders and then processed to its end."""
    stream = OrderStream(orders, payments, os.path.join(work_root, "deliveries"), os.path.join(work_root, "commands"), os.path.join(work_root, "out"), **settings)
    for arrived, told in slices(parts, payloads, commands):
        delivery_lines(arrived).write.mode("append").text(stream.deliveries)
        told.select("event_id", "ts", "order_id", "command").write.mode("append").parquet(stream.commands_path)
        stream.run_available()
    return stream


def replay_webhooks(payloads: DataFrame, work_root: str, parts: int = 2, **settings) -> DataFrame:
    """The accepted webhooks of a feed replayed through the first query alone."""
    stream = OrderStream(payloads, payloads, os.path.join(work_root, "deliveries"), "", os.path.join(work_root, "out"), **settings)
    for (arrived,) in slices(parts, payloads):
        delivery_lines(arrived).write.mode("append").text(stream.deliveries)
        stream.start_webhooks(available_now=True).awaitTermination()
    return stream.spark.read.schema(WEBHOOKS).parquet(stream.path("webhooks"))
