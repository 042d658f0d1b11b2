"""Broadcast only behind a size check.

Catalyst's optimized-plan statistics give an upper estimate of a relation's
size.  A side is broadcast only when that estimate is under the limit;
otherwise the join is left to the planner (sort-merge / shuffled hash, with
AQE free to switch at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_size_bytes(df: DataFrame) -> int | None:
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # statistics unavailable (e.g. streaming plan)
        return None
    # py4j hands back a Python int for Scala BigInt; keep a string fallback
    return int(size) if isinstance(size, int) else int(str(size.toString()))


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    size = estimated_size_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


# order ids are short strings: this many stay under the byte limit above
MAX_BROADCAST_KEYS = 1_000_000


def broadcast_if_few(keys: DataFrame, max_rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Broadcast a column of short keys whose estimate is small, or whose rows, counted, are few.

    Keys that come from a checkpoint carry no estimate; they are counted, up
    to ``max_rows + 1`` rows.
    """
    size = estimated_size_bytes(keys)
    few = size is not None and size <= DEFAULT_MAX_BROADCAST_BYTES
    return F.broadcast(keys) if few or keys.limit(max_rows + 1).count() <= max_rows else keys
