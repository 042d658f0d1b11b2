"""Webhook events and commands: ingest, routing, matching, effects, logs.

Batch and streaming share these functions; a micro-batch is just a smaller
DataFrame.  Lookups of orders by intent or session id are equi-joins against
an index built with one aggregate (newest order wins), never a scan per event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.functions import ids
from paytrail.functions.status import map_provider_status, payment_method
from paytrail.functions.text import or_empty, provider_id
from paytrail.operators.broadcast import broadcast_if_few, broadcast_if_small
from paytrail.operators.fold import STATE_COLUMNS, FoldResult, fold_order_state, guard_refunds, guard_syncs
from paytrail.schemas import MAX_WEBHOOK_BYTES, MSG_NO_INTENT, MSG_NOT_PAID, WEBHOOK_ENVELOPE
from paytrail.session import materialize

# handler name per handled webhook type (names are ours; types are fixed values)
PI_SUCCEEDED, PI_FAILED, PI_CANCELED = "payment_intent.succeeded", "payment_intent.payment_failed", "payment_intent.canceled"
CHECKOUT_TYPE = "checkout.session.completed"
HANDLERS = {PI_SUCCEEDED: "payment_succeeded", PI_FAILED: "payment_failed", PI_CANCELED: "payment_canceled",
            CHECKOUT_TYPE: "checkout_completed", "invoice.payment_succeeded": "invoice_paid",
            "charge.dispute.created": "dispute_created"}
PI_TYPES = [PI_SUCCEEDED, PI_FAILED, PI_CANCELED]
PI_OPS = {PI_SUCCEEDED: "succeeded", PI_FAILED: "failed", PI_CANCELED: "canceled"}   # op == payment status set
PI_ORDER_STATUS = {PI_SUCCEEDED: "paid", PI_CANCELED: "canceled"}                    # failure leaves the order alone


def _map(col: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


# --------------------------------------------------------------------- IO3 ---
def webhook_ingest(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Decode webhook envelopes; oversize or unreadable bodies get a reason.

    Size is checked first (the service stops reading at 64 KiB), then JSON.
    """
    body = F.col(payload_col)
    env = F.from_json(body, WEBHOOK_ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = payloads.withColumn("env", env)
    too_large = F.octet_length(body) > MAX_WEBHOOK_BYTES
    unreadable = F.col("env").isNull() | F.col("env._corrupt_record").isNotNull() | F.col("env.type").isNull()
    reason = F.when(too_large, F.lit("payload_too_large")).when(unreadable, F.lit("unreadable_payload"))
    d = d.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    obj = "env.data.object"

    def keep(c: Column) -> Column:
        return F.when(ok, c)

    keep_cols = [c for c in payloads.columns if c != payload_col]
    return d.select(
        *keep_cols,
        keep(F.col("env.id")).alias("envelope_id"),
        keep(F.col("env.type")).alias("type"),
        keep(F.col(f"{obj}.id")).alias("object_id"),
        keep(F.col(f"{obj}.amount")).alias("amount"),
        keep(F.col(f"{obj}.currency")).alias("currency"),
        keep(provider_id(F.col(f"{obj}.payment_intent"))).alias("payment_intent"),
        keep(provider_id(F.col(f"{obj}.charge"))).alias("charge"),
        keep(F.col(f"{obj}.customer_details").isNotNull()).alias("has_customer_details"),
        keep(F.col(f"{obj}.customer_details.email")).alias("customer_email"),
        keep(F.col(f"{obj}.customer_details.name")).alias("customer_name"),
        keep(F.col(f"{obj}.customer_details.phone")).alias("customer_phone"),
        "reject_reason",
    )


# --------------------------------------------------------------------- ST1 ---
def route_webhooks(webhooks: DataFrame) -> DataFrame:
    """Dispatch on type: six handled types, everything else ``unhandled``."""
    return webhooks.filter(F.col("reject_reason").isNull()).withColumn(
        "handler", _map(F.col("type"), HANDLERS, F.lit("unhandled")))


# ----------------------------------------------------------------- J3 / J4 ---
def newest_orders(orders: DataFrame, horizon: int) -> DataFrame:
    """The newest ``horizon`` orders (the reference searches only these)."""
    return orders.select("id", "created_at").orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(horizon)


# What a completed checkout writes: customer details and payment ids.
CHECKOUT_CUSTOMER = ("customer_email", "customer_name", "customer_phone")
CHECKOUT_IDS = ("session_id", "payment_intent_id")


def with_checkouts(rows: DataFrame, checkouts: DataFrame | None, keep: DataFrame | None = None) -> DataFrame:
    """``rows`` (order_id first) with the rows of orders in ``checkouts`` replaced by those of ``checkouts``."""
    if checkouts is None:
        return rows
    newer = checkouts.select(*rows.columns)
    if keep is not None:
        newer = newer.join(keep, keep.columns[0], "left_semi")
    return rows.join(checkouts.select("order_id"), "order_id", "left_anti").unionByName(newer)


def order_index(orders: DataFrame, payments: DataFrame, key: str, horizon: int | None = None,
                wanted: DataFrame | None = None, checkouts: DataFrame | None = None) -> DataFrame:
    """key (payment_intent_id or session_id) -> newest order carrying it.

    Empty keys never match.  ``horizon`` keeps only the newest N orders
    searchable, for parity with the reference's 1000-order scan.  ``wanted``
    (one column named ``key``) restricts the index to the keys a batch
    actually mentions, so a batch never joins every payment with every order.
    ``checkouts`` (order_id, session_id, payment_intent_id) overlays the ids
    that checkouts of earlier batches wrote.
    """
    o = orders.select("id", "created_at")
    if horizon is not None:
        o = o.join(broadcast_if_small(newest_orders(orders, horizon).select("id")), "id", "left_semi")
    p = payments.select("order_id", key)
    if wanted is not None:
        wanted = broadcast_if_few(wanted.filter(F.col(key).isNotNull()).distinct())
        p = p.join(wanted, key, "left_semi")
    p = with_checkouts(p.select("order_id", key), checkouts, wanted).filter(or_empty(F.col(key)) != "")
    return (p.withColumnRenamed("order_id", "id").join(o, "id", "inner").groupBy(key)
            .agg(F.max(F.struct("created_at", "id"))["id"].alias("order_id")))


def events_to_orders_by_intent(routed: DataFrame, orders: DataFrame, payments: DataFrame,
                               horizon: int | None = None, idx: DataFrame | None = None,
                               checkouts: DataFrame | None = None) -> DataFrame:
    """Payment-intent webhooks -> order by intent id (newest order wins)."""
    pi = routed.filter(F.col("type").isin(*PI_TYPES))
    if idx is None:
        idx = order_index(orders, payments, "payment_intent_id", horizon,
                          wanted=pi.select(F.col("object_id").alias("payment_intent_id")), checkouts=checkouts)
    idx = broadcast_if_small(idx)
    return pi.join(idx, pi["object_id"] == idx["payment_intent_id"], "left").drop("payment_intent_id")


def events_to_orders_by_session(routed: DataFrame, orders: DataFrame, payments: DataFrame,
                                horizon: int | None = None, idx: DataFrame | None = None,
                                checkouts: DataFrame | None = None) -> DataFrame:
    """Checkout sessions -> order by session id, else by the session's intent id."""
    cs = routed.filter(F.col("type") == CHECKOUT_TYPE)
    by_s = order_index(orders, payments, "session_id", horizon,
                       wanted=cs.select(F.col("object_id").alias("session_id")), checkouts=checkouts).withColumnRenamed("order_id", "s_order")
    if idx is None:
        idx = order_index(orders, payments, "payment_intent_id", horizon,
                          wanted=cs.select(F.col("payment_intent").alias("payment_intent_id")), checkouts=checkouts)
    by_s = broadcast_if_small(by_s)
    by_i = broadcast_if_small(idx.withColumnRenamed("order_id", "i_order"))
    j = (cs.join(by_s, cs["object_id"] == by_s["session_id"], "left").drop("session_id")
         .join(by_i, cs["payment_intent"] == by_i["payment_intent_id"], "left").drop("payment_intent_id"))
    return j.withColumn("order_id", F.coalesce("s_order", "i_order")).withColumn(
        "matched_by", F.when(F.col("s_order").isNotNull(), F.lit("session"))
        .when(F.col("i_order").isNotNull(), F.lit("payment_intent"))).drop("s_order", "i_order")


def match_webhooks(routed: DataFrame, orders: DataFrame, payments: DataFrame,
                   horizon: int | None = None, checkouts: DataFrame | None = None) -> DataFrame:
    """All state-changing webhooks with their order id (null = unmatched).

    One intent index serves both the payment-intent webhooks and the
    checkout fallback; it covers only the intent ids this batch mentions.
    """
    t = F.col("type")
    wanted = routed.filter(t.isin(*PI_TYPES) | (t == CHECKOUT_TYPE)).select(
        F.when(t == CHECKOUT_TYPE, F.col("payment_intent")).otherwise(F.col("object_id"))
        .alias("payment_intent_id"))
    idx = order_index(orders, payments, "payment_intent_id", horizon, wanted=wanted, checkouts=checkouts)
    pi = events_to_orders_by_intent(routed, orders, payments, horizon, idx).withColumn(
        "matched_by", F.when(F.col("order_id").isNotNull(), F.lit("payment_intent")))
    cs = events_to_orders_by_session(routed, orders, payments, horizon, idx, checkouts)
    return pi.unionByName(cs)


# ----------------------------------------------------------------- ST2-ST4 ---
def handler_effects(matched: DataFrame) -> DataFrame:
    """Per matched payment-intent webhook: the statuses it sets and its log kind."""
    t = F.col("type")
    return matched.filter(t.isin(*PI_TYPES) & F.col("order_id").isNotNull()).select(
        "event_id", "ts", "order_id", "handler",
        _map(t, PI_OPS).alias("payment_status_set"),
        _map(t, PI_ORDER_STATUS).alias("order_status_set"),
        (t == PI_SUCCEEDED).alias("sets_processed_at_if_null"),
    )


# --------------------------------------------------------------------- ST5 ---
def apply_checkout_completed(matched: DataFrame, orders: DataFrame, payments: DataFrame,
                             checkouts: DataFrame | None = None) -> DataFrame:
    """Customer and payment ids after all matched checkouts of each order.

    ``checkouts`` holds what earlier batches wrote (the columns of this
    result); it takes the place of the stored rows.

    Email is overwritten whenever customer details exist (even by ''); name
    and phone only by non-empty values; the session id always; the intent id
    when the session carries one.  Last writer by ``(ts, event_id)``.
    """
    seq = F.struct("ts", "event_id")
    cs = matched.filter((F.col("type") == CHECKOUT_TYPE) & F.col("order_id").isNotNull())
    det = F.coalesce(F.col("has_customer_details"), F.lit(False))
    def last(value: str, cond: Column | None = None) -> Column:
        """value of the latest row (by ts, event_id) where ``cond`` holds"""
        s = F.struct("ts", "event_id", F.col(value).alias("v"))
        return F.max(s if cond is None else F.when(cond, s))["v"]

    upd = cs.groupBy("order_id").agg(
        last("customer_email", det).alias("new_email"),
        F.max(F.when(det, seq)).alias("email_seq"),
        last("customer_name", det & (or_empty(F.col("customer_name")) != "")).alias("new_name"),
        last("customer_phone", det & (or_empty(F.col("customer_phone")) != "")).alias("new_phone"),
        last("object_id").alias("new_session"),
        last("payment_intent", F.col("payment_intent").isNotNull()).alias("new_intent"),
        F.count(F.lit(1)).alias("n_checkouts"),
        F.max("ts").alias("updated_at"),
    )
    ids = broadcast_if_few(upd.select("order_id"))  # one row per updated order
    o = orders.select(F.col("id").alias("order_id"), *CHECKOUT_CUSTOMER).join(ids, "order_id", "left_semi")
    p = payments.select("order_id", *CHECKOUT_IDS).join(ids, "order_id", "left_semi")
    o, p = with_checkouts(o, checkouts, ids), with_checkouts(p, checkouts, ids)
    j = upd.join(o, "order_id", "left").join(p, "order_id", "left")
    return j.select(
        "order_id",
        F.when(F.col("email_seq").isNotNull(), or_empty(F.col("new_email"))).otherwise(F.col("customer_email")).alias("customer_email"),
        F.coalesce("new_name", "customer_name").alias("customer_name"),
        F.coalesce("new_phone", "customer_phone").alias("customer_phone"),
        F.col("new_session").alias("session_id"),
        F.coalesce("new_intent", "payment_intent_id").alias("payment_intent_id"),
        "n_checkouts", "updated_at")


# --------------------------------------------------------------------- ST6 ---
def audit_only_events(routed: DataFrame) -> DataFrame:
    """Invoice paid -> invoice id; dispute created -> dispute id + charge id."""
    return routed.filter(F.col("handler").isin("invoice_paid", "dispute_created")).select(
        "event_id", "ts", "handler", F.col("object_id").alias("audit_id"), F.col("charge").alias("charge_id"))


# ------------------------------------------------------------- ops (fold) ---
def webhook_ops(matched: DataFrame, *carried: str) -> DataFrame:
    """Matched webhooks as ops; ``carried`` columns are kept beside them."""
    t = F.col("type")
    op = _map(t, {**PI_OPS, CHECKOUT_TYPE: "checkout"})
    return matched.filter(F.col("order_id").isNotNull() & op.isNotNull()).select(
        "order_id", "ts", "event_id", op.alias("op"),
        F.when(t == CHECKOUT_TYPE, F.col("payment_intent")).alias("set_intent"),
        F.coalesce(F.col("envelope_id"), F.concat(F.lit("feed_"), F.col("event_id").cast("string"))).alias("delivery_key"), *carried)


def existing_orders(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """The order ids among ``ids`` that exist.

    The orders table is the streamed side and the batch's ids the (size-
    checked) broadcast side, so a micro-batch never shuffles all orders.
    """
    wanted = broadcast_if_few(ids.select("order_id").distinct())
    return orders.select(F.col("id").alias("order_id")).join(wanted, "order_id", "left_semi")


def command_ops(commands: DataFrame, orders: DataFrame) -> DataFrame:
    """Commands addressed to existing orders (others go to the dead letter)."""
    c = commands.join(existing_orders(orders, commands), "order_id", "left_semi")
    return c.select("order_id", "ts", "event_id", F.col("command").alias("op"),
                    F.lit(None).cast("string").alias("set_intent"),
                    F.concat(F.lit("cmd_"), F.col("event_id").cast("string")).alias("delivery_key"))


def intent_known(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(F.max(or_empty(F.col("payment_intent_id")) != "").alias("intent_known"))


def raw_ops(matched: DataFrame, commands: DataFrame, orders: DataFrame, dedup: bool = False) -> DataFrame:
    """Webhook + command ops before the refund guard.

    ``dedup=True`` drops replayed events (same event id); the reference does
    not, so a replayed success can move a fulfilled order back to paid.
    """
    ops = webhook_ops(matched).unionByName(command_ops(commands, orders))
    if dedup:
        # a redelivered webhook carries the same envelope id: keep its first delivery
        cols = [c for c in ops.columns if c not in ("order_id", "delivery_key")]
        ops = (ops.groupBy("order_id", "delivery_key")
               .agg(F.min_by(F.struct(*cols), F.struct("ts", "event_id")).alias("d"))
               .select("order_id", "delivery_key", *[F.col(f"d.{c}").alias(c) for c in cols]))
    return ops


def stored_state(orders: DataFrame, payments: DataFrame, touched: DataFrame) -> DataFrame:
    """The state of the ``touched`` orders (order_id) as their stored rows have it: where a fold starts."""
    o = orders.withColumnRenamed("id", "order_id").join(touched, "order_id", "left_semi").select(
        "order_id", F.col("status").alias("order_status"), "fulfilled_at", "updated_at")
    p = payments.join(touched, "order_id", "left_semi").groupBy("order_id").agg(
        F.max(F.struct("processed_at", "status")).alias("p"),
        F.max(or_empty(F.col("payment_intent_id")) != "").alias("intent_known"))
    none = F.lit(0).cast("long")
    return o.join(p, "order_id", "left").select(
        "order_id", "order_status", F.col("p.status").alias("payment_status"), F.col("p.processed_at").alias("processed_at"),
        "fulfilled_at", "updated_at", none.alias("applied_events"), none.alias("rejected_fulfills"),
        none.alias("rejected_refunds"), F.coalesce("intent_known", F.lit(False)).alias("intent_known")).select(*STATE_COLUMNS)


# --------------------------------------------------------------------- ST8 ---
def dead_letter(webhooks: DataFrame, matched: DataFrame, commands: DataFrame, orders: DataFrame) -> DataFrame:
    """Everything the service would only log: unreadable or oversize bodies,
    unhandled types, webhooks without an order, commands for unknown orders."""
    rejected = webhooks.filter(F.col("reject_reason").isNotNull()).select(
        "event_id", F.lit("webhook").alias("source"), F.lit(None).cast("string").alias("type"),
        F.col("reject_reason").alias("reason"))
    routed = route_webhooks(webhooks)
    unhandled = routed.filter(F.col("handler") == "unhandled").select(
        "event_id", F.lit("webhook").alias("source"), "type", F.lit("unhandled_event_type").alias("reason"))
    unmatched = matched.filter(F.col("order_id").isNull()).select(
        "event_id", F.lit("webhook").alias("source"), "type", F.lit("order_not_found").alias("reason"))
    lost = commands.join(existing_orders(orders, commands), "order_id", "left_anti").select(
        "event_id", F.lit("command").alias("source"), F.concat(F.lit("command."), F.col("command")).alias("type"),
        F.lit("order_not_found").alias("reason"))
    return rejected.unionByName(unhandled).unionByName(unmatched).unionByName(lost)


# --------------------------------------------------------------------- ST9 ---
def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def event_log(matched: DataFrame, fold: FoldResult, ops: DataFrame,
              orders: DataFrame, payments: DataFrame, include_created: bool = True) -> DataFrame:
    """The payment-event log the service appends, with per-kind ``data`` JSON.

    ``order_created`` for every order whose intent was created (status past
    ``created``), then one row per applied webhook or accepted command.
    ``seq`` orders the log: 0 for creation, the source event id + 1 after.
    ``include_created=False`` leaves out the creation rows (a stream's
    micro-batch appends only what the batch did).
    """
    created = (orders.filter(F.col("status") != "created").select(F.col("id").alias("order_id"), "created_at")
               .join(payments.select("order_id", "payment_intent_id"), "order_id", "inner")
               .select("order_id", F.lit("order_created").alias("event_type"), F.lit("pending").alias("status"),
                       F.to_json(F.struct("payment_intent_id")).alias("data"),
                       "created_at", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("src")))
    t = F.col("type")
    m = matched.filter(F.col("order_id").isNotNull())
    pi = m.filter(t.isin(*PI_TYPES)).select(
        "order_id",
        _map(t, {k: HANDLERS[k] for k in PI_TYPES}).alias("event_type"),
        _map(t, PI_OPS).alias("status"),
        F.when(t == PI_SUCCEEDED,
               F.to_json(F.struct(F.col("object_id").alias("payment_intent_id"), "amount", "currency",
                                  payment_method().alias("payment_method"))))
        .when(t == PI_CANCELED,
              F.to_json(F.struct(F.col("object_id").alias("payment_intent_id"), _iso(F.col("ts")).alias("canceled_at"))))
        .otherwise(F.to_json(F.struct(F.col("object_id").alias("payment_intent_id")))).alias("data"),
        F.col("ts").alias("created_at"), (F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("src"))
    cs = m.filter(t == CHECKOUT_TYPE).select(
        "order_id", F.lit("checkout_completed").alias("event_type"), F.lit("succeeded").alias("status"),
        F.to_json(F.struct(F.col("object_id").alias("session_id"),
                           or_empty(F.col("payment_intent")).alias("payment_intent_id"),
                           or_empty(F.col("customer_email")).alias("customer_email"))).alias("data"),
        F.col("ts").alias("created_at"), (F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("src"))
    ful = fold.fulfill_decisions.filter("accepted").select(
        "order_id", F.lit("order_fulfilled").alias("event_type"), F.lit("succeeded").alias("status"),
        F.to_json(F.struct(_iso(F.col("ts")).alias("fulfilled_at"))).alias("data"),
        F.col("ts").alias("created_at"), (F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("src"))
    ref = ops.filter((F.col("op") == "refund") & F.coalesce(F.col("intent_ok"), F.lit(False))).select(
        "order_id", F.lit("order_refunded").alias("event_type"), F.lit("refunded").alias("status"),
        F.to_json(F.struct(_iso(F.col("ts")).alias("refunded_at"))).alias("data"),
        F.col("ts").alias("created_at"), (F.col("event_id") + 1).alias("seq"), F.col("event_id").alias("src"))
    log = pi.unionByName(cs).unionByName(ful).unionByName(ref)
    if include_created:
        log = created.unionByName(log)
    return log.select(ids.event_id(F.col("event_type"), F.col("order_id"), F.col("src")).alias("id"),
                      "order_id", "event_type", "status", "data", "created_at", "seq")


# ---------------------------------------------------------------------- J7 ---
def reconcile_provider_status(orders: DataFrame, payments: DataFrame, intents: DataFrame) -> DataFrame:
    """Sync local payment status with the provider's (mapped) status.

    Only orders with an intent id and a provider row are checked; rows are
    emitted where the mapped status differs.  A sync to ``succeeded`` marks
    the order paid only when processed_at was still null.  The response
    shows the new payment status with the old order status (``response_*``).
    """
    p = payments.filter(or_empty(F.col("payment_intent_id")) != "").select(
        "order_id", "payment_intent_id", F.col("status").alias("payment_status_before"), "processed_at")
    i = intents.select(F.col("id").alias("payment_intent_id"), F.col("status").alias("provider_status"))
    o = orders.select(F.col("id").alias("order_id"), F.col("status").alias("order_status_before"))
    j = p.join(i, "payment_intent_id", "inner").join(o, "order_id", "inner")
    new = map_provider_status(F.col("provider_status"))
    j = j.withColumn("payment_status_after", new).filter(
        ~F.col("payment_status_after").eqNullSafe(F.col("payment_status_before")))
    first_success = (F.col("payment_status_after") == "succeeded") & F.col("processed_at").isNull()
    return j.select(
        "order_id", "payment_intent_id", "provider_status", "payment_status_before", "payment_status_after",
        "order_status_before",
        F.when(first_success, F.lit("paid")).otherwise(F.col("order_status_before")).alias("order_status_after"),
        first_success.alias("sets_processed_at"),
        F.col("payment_status_after").alias("response_payment_status"),
        F.col("order_status_before").alias("response_order_status"))


def sync_ops(reconciled: DataFrame, as_of) -> DataFrame:
    """The rows of ``reconcile_provider_status`` as ops of a fold, at the time of the sync."""
    return reconciled.select(
        "order_id", F.lit(str(as_of)).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id"),
        F.concat(F.lit("sync_"), F.col("payment_status_after")).alias("op"), F.lit(None).cast("string").alias("set_intent"),
        F.concat(F.lit("sync_"), F.col("payment_intent_id")).alias("delivery_key"))


# ---------------------------------------------------------------- P10/P11 ---
def fulfillable_orders(orders: DataFrame) -> DataFrame:
    ok = F.col("status") == "paid"
    return orders.select("id", "status", ok.alias("accepted"),
                         F.when(~ok, F.lit(MSG_NOT_PAID)).alias("reason"))


def refundable_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Refund guard: an intent id must exist; the status is not checked."""
    k = intent_known(payments).withColumnRenamed("order_id", "id")
    j = orders.select("id", "status").join(k, "id", "left")
    ok = F.coalesce(F.col("intent_known"), F.lit(False))
    return j.select("id", "status", ok.alias("accepted"),
                    F.when(~ok, F.lit(MSG_NO_INTENT)).alias("reason"))


# ------------------------------------------------------------ batch driver ---
class EventBatch:
    """One batch (or micro-batch) of webhook payloads and commands.

    Every stage is built once and shared by the outputs: decoded webhooks,
    routed and matched webhooks, guarded ops, the order-state fold, the event
    log and the dead letter.  The fold starts from the stored order and
    payment rows.  ``later`` (a function of the touched order ids) gives the
    state rows that earlier batches left, in ``STATE_COLUMNS``; they take the
    place of the stored rows.  ``checkouts`` does the same for the customer
    details and payment ids written by earlier checkouts.  ``syncs`` adds
    provider-status syncs (``sync_ops``) to the ops.
    """

    def __init__(self, payloads: DataFrame, commands: DataFrame, orders: DataFrame, payments: DataFrame,
                 horizon: int | None = None, dedup: bool = False, later=None, checkouts: DataFrame | None = None,
                 syncs: DataFrame | None = None, checkpoint: bool = True):
        self.payloads, self.commands = payloads, commands
        self.orders, self.payments = orders, payments
        self.horizon, self.dedup, self._later, self._checkouts = horizon, dedup, later, checkouts
        self.syncs = syncs
        self._keep = materialize if checkpoint else (lambda df: df)

    @cached_property
    def webhooks(self) -> DataFrame:
        return self._keep(webhook_ingest(self.payloads))

    @cached_property
    def routed(self) -> DataFrame:
        return route_webhooks(self.webhooks)

    @cached_property
    def matched(self) -> DataFrame:
        return self._keep(match_webhooks(self.routed, self.orders, self.payments, self.horizon, self._checkouts))

    @cached_property
    def unguarded_ops(self) -> DataFrame:
        ops = raw_ops(self.matched, self.commands, self.orders, self.dedup)
        return ops if self.syncs is None else ops.unionByName(self.syncs)

    @cached_property
    def initial(self) -> DataFrame:
        """State of the orders this batch names, before it."""
        named = self.matched.filter(F.col("order_id").isNotNull()).select("order_id").unionByName(self.commands.select("order_id"))
        if self.syncs is not None:
            named = named.unionByName(self.syncs.select("order_id"))
        touched = broadcast_if_few(named.distinct())
        stored = stored_state(self.orders, self.payments, touched)
        if self._later is None:
            return stored
        later = self._later(touched)
        if later is not None:
            stored = stored.join(later.select("order_id"), "order_id", "left_anti").unionByName(later)
        # a micro-batch has several outputs: each reads these rows, none the stored tables again
        return self._keep(stored)

    @cached_property
    def ops(self) -> DataFrame:
        ops = guard_refunds(self.unguarded_ops, self.initial.select("order_id", "intent_known"))
        return self._keep(ops if self.syncs is None else guard_syncs(ops, self.initial))

    @cached_property
    def fold(self) -> FoldResult:
        return fold_order_state(self.ops, self.initial)

    def checkouts(self) -> DataFrame:
        """Customer details and payment ids of the orders with a checkout in this batch."""
        return apply_checkout_completed(self.matched, self.orders, self.payments, self._checkouts)

    def event_log(self, include_created: bool = True) -> DataFrame:
        return event_log(self.matched, self.fold, self.ops, self.orders, self.payments, include_created)

    def dead_letter(self) -> DataFrame:
        return dead_letter(self.webhooks, self.matched, self.commands, self.orders)
