"""Status mapping helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paytrail.schemas import PROVIDER_STATUS_MAP


def map_provider_status(provider_status: Column) -> Column:
    """Provider intent state -> payment status; unknown -> failed."""
    expr = None
    for src, dst in PROVIDER_STATUS_MAP.items():
        cond = provider_status == F.lit(src)
        expr = F.when(cond, F.lit(dst)) if expr is None else expr.when(cond, F.lit(dst))
    return expr.otherwise(F.lit("failed"))


def payment_method(_method_type: Column | None = None) -> Column:
    """The reference reports every payment method as card."""
    return F.lit("card")
