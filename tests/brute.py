"""Plain-Python reference of the order state machine (one order at a time)."""

from __future__ import annotations


def fold(ops, intent_known=False):
    """ops: iterable of (ts, event_id, op, set_intent).  Returns a dict."""
    s = dict(order_status="pending", payment_status="pending", processed_at=None, fulfilled_at=None,
             updated_at=None, applied_events=0, rejected_fulfills=0, rejected_refunds=0)
    intent = intent_known
    for ts, eid, op, set_intent in sorted(ops, key=lambda r: (r[0], r[1])):
        applied = True
        if op == "succeeded":
            s["payment_status"] = "succeeded"
            if s["processed_at"] is None:
                s["processed_at"] = ts
            s["order_status"] = "paid"
        elif op == "failed":
            s["payment_status"] = "failed"
        elif op == "canceled":
            s["payment_status"] = "canceled"
            s["order_status"] = "canceled"
        elif op == "checkout":
            if set_intent:
                intent = True
        elif op == "fulfill":
            if s["order_status"] == "paid":
                s["order_status"] = "fulfilled"
                if s["fulfilled_at"] is None:
                    s["fulfilled_at"] = ts
            else:
                applied = False
                s["rejected_fulfills"] += 1
        elif op == "refund":
            if intent:
                s["order_status"] = "refunded"
                s["payment_status"] = "refunded"
            else:
                applied = False
                s["rejected_refunds"] += 1
        if applied:
            s["applied_events"] += 1
            s["updated_at"] = ts if s["updated_at"] is None else max(s["updated_at"], ts)
    return s
