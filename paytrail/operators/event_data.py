"""The semi-structured ``data`` of payment events as VARIANT.

Each kind of event has its own members; a VARIANT holds them all and gives
each member by its type.  Text that is no JSON becomes a null VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# member -> type; a kind of event without the member has null
MEMBERS = {"payment_intent_id": "string", "amount": "bigint", "currency": "string", "payment_method": "string", "session_id": "string",
           "customer_email": "string", "canceled_at": "timestamp", "fulfilled_at": "timestamp", "refunded_at": "timestamp"}


def with_variant(log: DataFrame) -> DataFrame:
    """``log`` with ``data`` as VARIANT."""
    return log.withColumn("data", F.try_parse_json("data"))


def member(name: str, data: str = "data") -> Column:
    """A member of the VARIANT in its type; times in UTC without a zone."""
    value = F.try_variant_get(data, f"$.{name}", MEMBERS[name])
    return (value.cast("timestamp_ntz") if MEMBERS[name] == "timestamp" else value).alias(name)


def typed_event_data(log: DataFrame) -> DataFrame:
    """(id, order_id, event_type, every member in its type) of events of all kinds."""
    return with_variant(log).select("id", "order_id", "event_type", *[member(m) for m in MEMBERS])
