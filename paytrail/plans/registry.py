"""All registered queries and their oracle SQL."""

from __future__ import annotations

from paytrail.plans import q_events, q_intake, q_quality, q_reports, q_tables  # noqa: F401  (registers)
from paytrail.plans.base import QUERIES
from paytrail.plans.oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]
