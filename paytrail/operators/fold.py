"""Order state as a fold of payment events and commands (ST7, ST10).

State machine (per order, in arrival order ``seq = (ts, event_id)``):

    op          payment status   order status
    succeeded   succeeded        paid            (processed_at set once)
    failed      failed           unchanged
    canceled    canceled         canceled
    checkout    unchanged        unchanged       (customer / id updates only)
    refund      refunded         refunded        only when an intent id is known
    fulfill     unchanged        fulfilled       only when the status is paid
                                                 (fulfilled_at set once)
    sync_<s>    s                paid            only when s is succeeded and
                                                 processed_at was not set

Only "setters" (succeeded, canceled, accepted refund) and fulfills move the
order status, and a fulfill is accepted exactly when the previous status
event of the order is a ``succeeded``.  That makes the fold a lag over the
status events, which we evaluate without putting a whole order in one task:

1. Every order is cut into *segments* of time at constant cut points, so one
   hot order is spread over many tasks.
2. Inside a segment, ``lag`` decides every fulfill except the segment's first
   event; a segment is summarised by a handful of aggregates.
3. Segment summaries (at most ``MAX_SEGMENTS`` per order) are composed in
   order with the higher-order ``aggregate`` function.

Payment status, processed_at and counters are order-independent aggregates
(``max`` / ``min`` / ``count_if``) with map-side partial aggregation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.functions.text import or_empty

STATE_COLUMNS = ("order_id", "order_status", "payment_status", "processed_at", "fulfilled_at",
                 "updated_at", "applied_events", "rejected_fulfills", "rejected_refunds", "intent_known")


class FoldResult(NamedTuple):
    state: DataFrame              # one row per order with ops
    fulfill_decisions: DataFrame  # order_id, ts, event_id, accepted (one per fulfill)
    segments: DataFrame           # one summary row per (order_id, seg): how a hot order was split


def guard_refunds(ops: DataFrame, intents: DataFrame) -> DataFrame:
    """Add ``intent_ok`` to refund ops: an intent id is known at their position.

    Known = the order's intent id before this batch (``intents``: order_id,
    intent_known) or set by an earlier checkout carrying a non-empty intent.
    Only refunds are joined; other ops carry a null ``intent_ok``.
    """
    seq = F.struct("ts", "event_id")
    refunds = ops.filter(F.col("op") == "refund")
    first_set = (ops.filter((F.col("op") == "checkout") & (or_empty(F.col("set_intent")) != ""))
                 .groupBy("order_id").agg(F.min(seq).alias("first_intent_seq")))
    j = (refunds.join(first_set, "order_id", "left")
         .join(intents.select("order_id", "intent_known"), "order_id", "left"))
    ok = F.coalesce(F.col("intent_known"), F.lit(False)) | F.coalesce(seq > F.col("first_intent_seq"), F.lit(False))
    guarded = j.withColumn("intent_ok", ok).drop("first_intent_seq", "intent_known")
    rest = ops.filter(F.col("op") != "refund").withColumn("intent_ok", F.lit(None).cast("boolean"))
    return rest.unionByName(guarded)


def guard_syncs(ops: DataFrame, initial: DataFrame) -> DataFrame:
    """Add ``first_success`` to provider syncs to succeeded: no success came before, stored (``initial``) or in ``ops``.

    Only these syncs are joined; other ops carry a null ``first_success``.
    """
    seq = F.struct("ts", "event_id")
    is_sync = F.col("op") == "sync_succeeded"
    first = ops.filter(F.col("op").isin("succeeded", "sync_succeeded")).groupBy("order_id").agg(F.min(seq).alias("first_seq"))
    j = (ops.filter(is_sync).join(first, "order_id", "left")
         .join(initial.select("order_id", F.col("processed_at").alias("stored")), "order_id", "left"))
    guarded = j.withColumn("first_success", (seq == F.col("first_seq")) & F.col("stored").isNull()).drop("first_seq", "stored")
    return ops.filter(~is_sync).withColumn("first_success", F.lit(None).cast("boolean")).unionByName(guarded)


# An order is cut into at most this many segments of time.
MAX_SEGMENTS = 256


def _num_segments(ops: DataFrame) -> int:
    return min(MAX_SEGMENTS, int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _segment(status_ops: DataFrame, n: int) -> Column:
    """Segment number of an op: which of n quantiles of all status events' times it lies in.

    The cut points are computed once and become constants, so an op's segment follows from the op alone however
    often Spark evaluates it.  An order with a large share of the events is cut as finely as the events are; events
    of one instant share a segment.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    found = status_ops.select(F.percentile_approx(micros, F.lit([i / n for i in range(1, n)] or [0.5]), 10_000)).first()[0]
    cuts = sorted(set(found or [])) if n > 1 else []

    def tree(lo: int, hi: int) -> Column:  # a balanced search over cuts[lo:hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(micros <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def fold_order_state(ops: DataFrame, initial: DataFrame | None = None,
                     num_segments: int | None = None) -> FoldResult:
    """Fold ``ops`` (order_id, ts, event_id, op, intent_ok, set_intent, first_success if there are syncs) into order state.

    ``initial`` (optional) holds the state before these ops in the columns of
    ``STATE_COLUMNS``; without it every order starts pending/pending.
    One path at every size: each order is cut into segments of time
    (``num_segments``, by default the shuffle partitions up to
    ``MAX_SEGMENTS``), segments are folded in parallel and composed in order.
    """
    op = F.col("op")
    seq = F.struct("ts", "event_id")
    refund_ok = (op == "refund") & F.coalesce(F.col("intent_ok"), F.lit(False))
    synced = op.startswith("sync_")
    success = op.isin("succeeded", "sync_succeeded")
    first_sync = (op == "sync_succeeded") & F.coalesce(F.col("first_success"), F.lit(False)) if "first_success" in ops.columns else F.lit(False)
    kind = (F.when((op == "succeeded") | first_sync, "paid").when(op == "canceled", "canceled")
            .when(refund_ok, "refunded").when(op == "fulfill", "F"))
    pay = (F.when(op.isin("succeeded", "failed", "canceled"), op).when(refund_ok, "refunded")
           .when(synced, F.substring(op, len("sync_") + 1, 20)))
    always_applied = op.isin("succeeded", "failed", "canceled", "checkout") | refund_ok | synced

    # "value at the greatest (ts, event_id)" is written max(struct(ts, event_id, value)).value:
    # the ordering key leads the struct, which aggregates faster than max_by with a struct key
    side = ops.groupBy("order_id").agg(
        F.max(F.when(pay.isNotNull(), F.struct("ts", "event_id", pay.alias("v"))))["v"].alias("last_payment_status"),
        F.min(F.when(success, F.col("ts"))).alias("first_success_ts"),
        F.max(F.when(always_applied, F.col("ts"))).alias("last_applied_ts"),
        F.count_if(always_applied).alias("n_applied"),
        F.count_if(op == "fulfill").alias("n_fulfill"),
        F.count_if((op == "refund") & ~refund_ok).alias("n_rejected_refunds"),
        F.max(F.when((op == "checkout") & (or_empty(F.col("set_intent")) != ""), F.lit(True))).alias("sets_intent"),
    )

    # --- status events, split into ordered segments --------------------------
    st = ops.select("order_id", "ts", "event_id", kind.alias("kind")).filter(F.col("kind").isNotNull())
    st = st.withColumn("seg", _segment(st, num_segments or _num_segments(ops)))
    w = Window.partitionBy("order_id", "seg").orderBy("ts", "event_id")
    st = st.withColumn("prev", F.lag("kind").over(w)).withColumn(
        "acc", (F.col("kind") == "F") & F.coalesce(F.col("prev") == "paid", F.lit(False)))
    is_f = F.col("kind") == "F"
    segs = st.groupBy("order_id", "seg").agg(
        F.min(F.struct("ts", "event_id", "kind"))["kind"].alias("first_kind"),
        F.min("ts").alias("first_ts"),
        F.count_if("acc").alias("inner_acc"),
        F.min(F.when(F.col("acc"), F.col("ts"))).alias("inner_acc_min"),
        F.max(F.when(F.col("acc"), F.col("ts"))).alias("inner_acc_max"),
        F.count_if(is_f).alias("n_f"),
        F.max(F.when(~is_f, F.struct("ts", "event_id", "kind")))["kind"].alias("last_setter"),
        F.max(F.when(~is_f, seq)).alias("last_setter_seq"),
        F.max(F.when(is_f, seq)).alias("last_f_seq"),
    )
    per_order = segs.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in segs.columns if c != "order_id"]))).alias("segs"))

    base = side.join(per_order, "order_id", "left")
    if initial is not None:
        base = base.join(initial.select(*STATE_COLUMNS), "order_id", "left")
    else:
        for c, t in (("order_status", "string"), ("payment_status", "string"), ("processed_at", "timestamp_ntz"),
                     ("fulfilled_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"),
                     ("applied_events", "long"), ("rejected_fulfills", "long"),
                     ("rejected_refunds", "long"), ("intent_known", "boolean")):
            base = base.withColumn(c, F.lit(None).cast(t))

    start_status = F.coalesce(F.col("order_status"), F.lit("pending"))
    init = F.struct(
        start_status.alias("status"),
        F.lit(0).cast("long").alias("n_acc"),
        F.lit(None).cast("timestamp_ntz").alias("first_acc"),
        F.lit(None).cast("timestamp_ntz").alias("last_acc"),
        F.array().cast("array<struct<seg:int,incoming:string>>").alias("incoming"),
    )

    def merge(acc: Column, x: Column) -> Column:
        lead = (x["first_kind"] == "F") & (acc["status"] == "paid")
        lead_ts = F.when(lead, x["first_ts"])
        after = F.when(x["last_setter"].isNotNull(),
                       F.when((x["last_setter"] == "paid") & F.coalesce(x["last_f_seq"] > x["last_setter_seq"], F.lit(False)),
                              F.lit("fulfilled")).otherwise(x["last_setter"])) \
            .otherwise(F.when((acc["status"] == "paid") & (x["n_f"] > 0), F.lit("fulfilled")).otherwise(acc["status"]))
        return F.struct(
            after.alias("status"),
            (acc["n_acc"] + x["inner_acc"] + F.when(lead, 1).otherwise(0)).alias("n_acc"),
            F.coalesce(acc["first_acc"], lead_ts, x["inner_acc_min"]).alias("first_acc"),
            F.coalesce(x["inner_acc_max"], lead_ts, acc["last_acc"]).alias("last_acc"),
            F.concat(acc["incoming"], F.array(F.struct(x["seg"].alias("seg"), acc["status"].alias("incoming")))).alias("incoming"),
        )

    folded = base.withColumn("f", F.aggregate(F.coalesce(F.col("segs"), F.array().cast(per_order.schema["segs"].dataType)),
                                              init, merge))
    f = F.col("f")
    state = folded.select(
        "order_id",
        f["status"].alias("order_status"),
        F.coalesce(F.col("last_payment_status"), F.col("payment_status"), F.lit("pending")).alias("payment_status"),
        F.coalesce(F.col("processed_at"), F.col("first_success_ts")).alias("processed_at"),
        F.coalesce(F.col("fulfilled_at"), f["first_acc"]).alias("fulfilled_at"),
        F.greatest(F.col("updated_at"), F.col("last_applied_ts"), f["last_acc"]).alias("updated_at"),
        (F.coalesce(F.col("applied_events"), F.lit(0)) + F.col("n_applied") + f["n_acc"]).alias("applied_events"),
        (F.coalesce(F.col("rejected_fulfills"), F.lit(0)) + F.col("n_fulfill") - f["n_acc"]).alias("rejected_fulfills"),
        (F.coalesce(F.col("rejected_refunds"), F.lit(0)) + F.col("n_rejected_refunds")).alias("rejected_refunds"),
        (F.coalesce(F.col("intent_known"), F.lit(False)) | F.coalesce(F.col("sets_intent"), F.lit(False))).alias("intent_known"),
    )

    incoming = folded.select("order_id", F.explode(f["incoming"]).alias("i")).select(
        "order_id", F.col("i.seg").alias("seg"), F.col("i.incoming").alias("incoming"))
    decisions = (st.filter(is_f).join(incoming, ["order_id", "seg"], "left")
                 .select("order_id", "ts", "event_id",
                         (F.col("acc") | (F.col("prev").isNull()
                                          & F.coalesce(F.col("incoming") == "paid", F.lit(False)))).alias("accepted")))
    return FoldResult(state, decisions, segs)


def touch_payments(ops: DataFrame, payments: DataFrame) -> DataFrame:
    """ST10 on payments: (order_id, updated_at) of the payment rows that ``ops`` change.

    Webhooks and accepted refunds write the payment's status or ids; a fulfilment writes the order alone.
    """
    op = F.col("op")
    writes = op.isin("succeeded", "failed", "canceled", "checkout") | op.startswith("sync_") | ((op == "refund") & F.coalesce(F.col("intent_ok"), F.lit(False)))
    last = ops.filter(writes).groupBy("order_id").agg(F.max("ts").alias("last"))
    return payments.select("order_id", "updated_at").join(last, "order_id").select("order_id", F.greatest("updated_at", "last").alias("updated_at"))
