"""Keyed state of the stream, kept in Spark's own state store.

``MatchOrders`` finds the order of a webhook by its payment ids, as earlier
checkouts left them.  ``OrderSegments`` folds an order's events of one segment
of time.  Both are processors for ``transformWithState``; their state lives in
RocksDB under the query's checkpoint and is read back with the ``statestore``
source.

A call of a processor costs about a millisecond however few rows it gets, and
most payment ids and segments have one row in a micro-batch.  Rows are therefore
grouped by a hash bucket of their key; the state of each key is one entry of the
bucket's map state, which holds many entries a row (``Entries``).

A segment does not know the order's state before it.  What an event does
depends on two facts only: whether the order is paid, and whether an intent id
is known.  A segment's summary therefore holds one outcome for each of the four
cases, and ``compose`` walks an order's segments in time from its stored rows,
taking the outcome that fits.  So one hot order is spread over its segments,
and a key's state has a fixed size.

Events of one key are applied by ``(ts, event_id)`` inside a micro-batch and
in arrival order across micro-batches, as the service does.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paytrail.functions.text import or_empty
from paytrail.operators.events import CHECKOUT_CUSTOMER, CHECKOUT_IDS, stored_state
from paytrail.operators.fold import STATE_COLUMNS

# what a webhook carries through the matching
CARRIED = ("event_id", "ts", "envelope_id", "type", "object_id", "amount", "currency", "payment_intent",
           "has_customer_details", "customer_email", "customer_name", "customer_phone")
MATCHED = ("event_id bigint, ts timestamp_ntz, envelope_id string, type string, object_id string, amount bigint, currency string, "
           "payment_intent string, has_customer_details boolean, customer_email string, customer_name string, customer_phone string, "
           "order_id string, matched_by string")


# groups that the rows of a micro-batch are dealt to; fixed, as the state is kept by them
BUCKETS = 2048


def bucket(*key: str) -> Column:
    """The group of a key."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")


def _by_key(rows: Iterator[Row], *key: str) -> dict[tuple, list[Row]]:
    """A bucket's rows of this micro-batch by their key."""
    out: dict[tuple, list[Row]] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in key), []).append(r)
    return out


# what the matching does not look at goes through it as one text: a value costs a row about a microsecond and more in Python
PACKED = tuple(c for c in CARRIED if c not in ("event_id", "ts"))
MATCHES = "event_id bigint, ts timestamp_ntz, packed string, order_id string, matched_by string"


def pack(rows: DataFrame) -> DataFrame:
    return rows.withColumn("packed", F.to_json(F.struct(*PACKED))).drop(*PACKED)


def unpack(matches: DataFrame) -> DataFrame:
    """``MATCHES`` -> ``MATCHED``."""
    fields = ", ".join(f for f in MATCHED.split(", ") if f.split(" ")[0] in PACKED)
    return matches.withColumn("p", F.from_json("packed", fields)).select("event_id", "ts", "p.*", "order_id", "matched_by")


def text_of(t: datetime | None) -> str | None:
    """A time as text that sorts as the time does."""
    return None if t is None else t.isoformat(timespec="microseconds")


class Entries:
    """A bucket's entries by key, about ``SHARE`` of them in a row of its map state as one JSON text: a call to the state
    and a typed value in it cost far more than an entry of such a text.  A time in an entry is text too (``text_of``).

    The rows are numbered; a key is in the row of its hash, and the number of rows doubles as the entries grow.  A
    micro-batch reads and writes the rows of its keys, in one pass where these are not much fewer than all rows (times
    ``READ_ALL``).  Reading is thus bounded by the micro-batch, not by the state.
    """

    SHARE = 32
    READ_ALL = 4

    def __init__(self, handle: StatefulProcessorHandle, name: str, key_fields: int):
        self.key_fields = key_fields
        self.map = handle.getMapState(name, "part int", "entries string")
        self.size = handle.getValueState(f"{name}_size", "n bigint, parts int")

    @staticmethod
    def _part(key: tuple, parts: int) -> int:
        return zlib.crc32("\0".join(map(str, key)).encode("utf-8", "backslashreplace")) % parts

    def _load(self, parts: set[int]) -> None:
        if len(parts) > 1 and self.parts <= self.READ_ALL * len(parts):
            found = [(k[0], v) for k, v in self.map.iterator() if k[0] in parts]
        else:
            found = [(p, self.map.getValue((p,))) for p in parts]
        k = self.key_fields
        self.rows |= {p: {tuple(e[:k]): e[k:] for e in json.loads(v[0])} for p, v in found if v is not None}

    def read(self, wanted: dict[tuple, list[Row]]) -> dict[tuple, list]:
        """The entries of the wanted keys, where there are any."""
        self.n, self.parts = self.size.get() or (0, 1)
        self.rows: dict[int, dict[tuple, list]] = {}
        if self.n:
            self._load({self._part(k, self.parts) for k in wanted})
        return {k: v for entries in self.rows.values() for k, v in entries.items() if k in wanted}

    def write(self, changed: dict[tuple, list]) -> None:
        """Write the changed entries, whose keys were all read."""
        if not changed:
            return
        before, touched = self.n, set()
        for k, v in changed.items():
            p = self._part(k, self.parts)
            own = self.rows.setdefault(p, {})
            self.n += k not in own
            own[k] = v
            touched.add(p)
        parts = self.parts
        while self.n > self.SHARE * parts:
            parts *= 2
        if parts > self.parts:
            if before:
                self._load(set(range(self.parts)) - set(self.rows))
            dealt: dict[int, dict[tuple, list]] = {p: {} for p in range(parts)}
            for entries in self.rows.values():
                for k, v in entries.items():
                    dealt[self._part(k, parts)][k] = v
            self.rows, self.parts, touched = dealt, parts, set(dealt)
        for p in touched:
            self.map.updateValue((p,), (json.dumps([[*k, *v] for k, v in self.rows[p].items()]),))
        if self.n > before:
            self.size.update((self.n, self.parts))


class MatchOrders(StatefulProcessor):
    """Key: bucket of (payment id, salt).  Rows: ``event`` wants its order, ``claim`` and ``release`` change whose id it is.

    State: per payment id the orders that checkouts gave it, and those it was taken from.  Claims go to all salts of an
    id, so salts that share a bucket may share the entry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = Entries(handle, "owners", 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        wanted = _by_key(rows, "id")
        before, after = self.owners.read(wanted), {}
        for payment_id, own in wanted.items():
            yield from self._match(payment_id, own, before.get(payment_id), after)
        self.owners.write(after)

    @staticmethod
    def _match(key: tuple, rows: list[Row], before: list | None, after: dict) -> Iterator[Row]:
        """The webhooks of one payment id with their orders; ``after`` takes the id's entry if it changes."""
        claimed = dict(before[0]) if before else {}
        released = set(before[1]) if before else set()
        changed = False
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id, r.kind != "event")):
            if r.kind == "claim":
                claimed[r.index_order] = text_of(r.index_created)
                released.discard(r.index_order)
                changed = True
            elif r.kind == "release":
                claimed.pop(r.index_order, None)
                released.add(r.index_order)
                changed = True
            else:
                order, by = r.session_order, "session" if r.session_order is not None else None
                if order is None:
                    found = dict(claimed)
                    if r.index_order is not None and r.index_order not in released:
                        found[r.index_order] = text_of(r.index_created)
                    if found:  # the newest order that carries the id
                        order = max(found.items(), key=lambda x: (x[1], x[0]))[0]
                        by = "session" if key[0].startswith("s:") else "payment_intent"
                yield Row(event_id=r.event_id, ts=r.ts, packed=r.packed, order_id=order, matched_by=by)
        if changed:
            after[key] = [sorted(claimed.items()), sorted(released)]

    def close(self) -> None:
        pass


OUTCOME = ("status string, known boolean, accepted long, first_accepted timestamp_ntz, last_accepted timestamp_ntz, rejected_fulfills long, "
           "rejected_refunds long, applied long, last_applied timestamp_ntz, payment_status string")
# what an entry holds after its key and its four outcomes
SUMMARY = ("processed_at timestamp_ntz, checkouts long, last_checkout timestamp_ntz, has_email boolean, email string, name string, phone string, "
           "session_id string, intent string")
DECISIONS = "order_id string, seg bigint, ts timestamp_ntz, event_id bigint, op string, accepted array<boolean>"


class OrderSegments(StatefulProcessor):
    """Key: bucket of (order id, segment).  State: per order and segment its outcome in each of the four cases, and what its checkouts wrote."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.summary = Entries(handle, "summary", 2)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        wanted = _by_key(rows, "order_id", "seg")
        before, after = self.summary.read(wanted), {}
        for segment, own in wanted.items():
            yield from self._fold(segment, own, before.get(segment), after)
        self.summary.write(after)

    def _fold(self, key: tuple, rows: list[Row], kept: list | None, after: dict) -> Iterator[Row]:
        """What the rows of one segment did in each case; ``after`` takes the segment's new entry."""
        if kept is not None:
            outcomes, rest = [list(o) for o in kept[0]], list(kept[1:])
        else:
            outcomes, rest = [[None, bool(case & 1), 0, None, None, 0, 0, 0, None, None] for case in range(4)], [None, 0, None, False, None, None, None, None, None]
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            op, at, set_intent = r.op, text_of(r.ts), r.set_intent
            accepted = [self.apply(o, bool(case & 2), op, at, set_intent) for case, o in enumerate(outcomes)]
            if op == "succeeded":
                rest[0] = at if rest[0] is None else min(rest[0], at)
            elif op == "checkout":
                rest[1] += 1
                rest[2] = at if rest[2] is None else max(rest[2], at)
                if r.has_customer_details:
                    rest[3], rest[4] = True, r.customer_email or ""
                    rest[5], rest[6] = r.customer_name or rest[5], r.customer_phone or rest[6]
                rest[7] = r.object_id
                rest[8] = set_intent if set_intent is not None else rest[8]
            yield Row(order_id=key[0], seg=key[1], ts=r.ts, event_id=r.event_id, op=op, accepted=accepted)
        after[key] = [outcomes, *rest]

    @staticmethod
    def apply(o: list, was_paid: bool, op: str, at: str | None, set_intent: str | None) -> bool:
        """Apply one op to an outcome (fields as in ``OUTCOME``); false if it is refused."""
        if op == "fulfill":
            if not (o[0] == "paid" or (o[0] is None and was_paid)):
                o[5] += 1
                return False
            o[0], o[2] = "fulfilled", o[2] + 1
            o[3] = at if o[3] is None else min(o[3], at)
            o[4] = at if o[4] is None else max(o[4], at)
            return True
        if op == "refund" and not o[1]:
            o[6] += 1
            return False
        if op in ("succeeded", "canceled", "refund"):
            o[0] = {"succeeded": "paid", "canceled": "canceled", "refund": "refunded"}[op]
        if op != "checkout":
            o[9] = "refunded" if op == "refund" else op
        elif set_intent:
            o[1] = True
        o[7] += 1
        o[8] = at if o[8] is None else max(o[8], at)
        return True

    def close(self) -> None:
        pass


def _fields(ddl: str, values: Column, at: int = 0) -> list[Column]:
    """The texts of ``values`` from ``at`` on as the typed fields of ``ddl``."""
    return [F.get(values, F.lit(at + i)).cast(t).alias(c) for i, (c, t) in enumerate(f.split(" ") for f in ddl.split(", "))]


def segment_summaries(rows: Column) -> Column:
    """The rows that ``OrderSegments`` keeps (JSON texts) as arrays of (order_id, seg, s)."""
    texts = lambda c: F.from_json(c, "array<array<string>>", {"mode": "FAILFAST"})
    key = "order_id string, seg bigint"

    def summary(e: Column) -> Column:
        outcomes = F.transform(texts(F.get(e, F.lit(2))), lambda o: F.struct(*_fields(OUTCOME, o)))
        return F.struct(*_fields(key, e), F.struct(outcomes.alias("outcomes"), *_fields(SUMMARY, e, 3)).alias("s"))

    return F.transform(texts(rows), summary)


def _case(status: Column, known: Column) -> Column:
    """Which of the four outcomes holds (counted from 1)."""
    return 1 + F.when(status == "paid", 2).otherwise(0) + F.when(known, 1).otherwise(0)


def compose(summaries: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Per order: ``STATE_COLUMNS``, ``cases`` (segment -> case it was entered in) and what checkouts wrote.

    ``summaries`` holds (order_id, seg, s); an order has one row a segment of time with events.
    """
    segs = summaries.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("seg", "s"))).alias("segs"))
    start = stored_state(orders, payments, segs.select("order_id"))
    j = segs.join(start, "order_id")
    init = F.struct(F.coalesce("order_status", F.lit("pending")).alias("order_status"), F.col("payment_status"), F.col("processed_at"), F.col("fulfilled_at"),
                    F.col("updated_at"), F.col("applied_events"), F.col("rejected_fulfills"), F.col("rejected_refunds"), F.col("intent_known"),
                    F.array().cast("array<struct<seg:bigint,case:int>>").alias("cases"))

    def merge(a: Column, x: Column) -> Column:
        case = _case(a["order_status"], a["intent_known"])
        o = F.element_at(x["s"]["outcomes"], case)
        return F.struct(
            F.coalesce(o["status"], a["order_status"]).alias("order_status"),
            F.coalesce(o["payment_status"], a["payment_status"]).alias("payment_status"),
            F.coalesce(a["processed_at"], x["s"]["processed_at"]).alias("processed_at"),
            F.coalesce(a["fulfilled_at"], o["first_accepted"]).alias("fulfilled_at"),
            F.greatest(a["updated_at"], o["last_applied"], o["last_accepted"]).alias("updated_at"),
            (a["applied_events"] + o["applied"] + o["accepted"]).alias("applied_events"),
            (a["rejected_fulfills"] + o["rejected_fulfills"]).alias("rejected_fulfills"),
            (a["rejected_refunds"] + o["rejected_refunds"]).alias("rejected_refunds"),
            (a["intent_known"] | o["known"]).alias("intent_known"),
            F.concat(a["cases"], F.array(F.struct(x["seg"].alias("seg"), case.alias("case")))).alias("cases"))

    def wrote(a: Column, x: Column) -> Column:
        s = x["s"]
        last = {c: F.coalesce(s[c], a[c]).alias(c) for c in ("name", "phone", "session_id", "intent", "last_checkout")}
        return F.struct((a["n"] + s["checkouts"]).alias("n"), (a["has_email"] | s["has_email"]).alias("has_email"),
                        F.when(s["has_email"], s["email"]).otherwise(a["email"]).alias("email"), *last.values())

    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("email", "string"), ("name", "string"), ("phone", "string"), ("session_id", "string"), ("intent", "string"), ("last_checkout", "timestamp_ntz"))}
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("has_email"), *none.values())
    j = j.withColumn("f", F.aggregate("segs", init, merge)).withColumn("w", F.aggregate("segs", nothing, wrote))
    state = [F.coalesce(F.col("f.payment_status"), F.lit("pending")).alias(c) if c == "payment_status" else F.col(f"f.{c}").alias(c) for c in STATE_COLUMNS if c != "order_id"]
    return j.select("order_id", *state, F.col("f.cases").alias("cases"), F.col("w").alias("wrote"))


def checkout_rows(composed: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Customer details and payment ids of the orders with a checkout: what the last checkouts wrote over the stored rows."""
    w = composed.filter("wrote.n > 0").select("order_id", "wrote.*")
    o = orders.select(F.col("id").alias("order_id"), *CHECKOUT_CUSTOMER)
    p = payments.select("order_id", *CHECKOUT_IDS).withColumnsRenamed({"session_id": "old_session", "payment_intent_id": "old_intent"})
    j = w.join(o, "order_id", "left").join(p, "order_id", "left")
    return j.select("order_id", F.when(F.col("has_email"), or_empty(F.col("email"))).otherwise(F.col("customer_email")).alias("customer_email"),
                    F.coalesce("name", "customer_name").alias("customer_name"), F.coalesce("phone", "customer_phone").alias("customer_phone"),
                    F.coalesce("session_id", "old_session").alias("session_id"), F.coalesce("intent", "old_intent").alias("payment_intent_id"),
                    F.col("last_checkout").alias("updated_at"))
