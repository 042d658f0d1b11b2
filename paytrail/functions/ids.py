"""Deterministic identifiers.

The reference draws ids at random; random ids would change when Spark retries
a task, so ours are hashes of the natural key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_id(key: Column) -> Column:
    """S3: ``ORD`` + 16 hex digits."""
    return F.concat(F.lit("ORD"), F.substring(F.sha2(key.cast("string"), 256), 1, 16))


def tracking_id(key: Column) -> Column:
    """S3: ``TRK`` + 16 hex digits."""
    return F.concat(F.lit("TRK"), F.substring(F.sha2(F.concat(F.lit("t:"), key.cast("string")), 256), 1, 16))


def event_id(*parts: Column) -> Column:
    """S3: ``evt_`` + hash of the event's natural key."""
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))
