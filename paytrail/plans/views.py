"""SQL surface: the model tables and the reference's two views as temp views.

After ``register_views(spark, tables, as_of)`` a user can run the SQL they ran
against the reference's database, e.g. ``SELECT * FROM order_summaries`` or
``SELECT total_revenue_cents FROM payment_stats``; Catalyst plans it the
same way as the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paytrail.operators import reports as R

MODEL_TABLES = ("orders", "order_items", "payments", "payment_events")


def register_views(spark: SparkSession, tables: dict[str, DataFrame], as_of) -> list[str]:
    """Register the given model tables plus ``order_summaries`` and ``payment_stats``."""
    names = []
    for name in MODEL_TABLES:
        if name in tables:
            tables[name].createOrReplaceTempView(name)
            names.append(name)
    R.order_summaries_view(tables["orders"], tables["payments"], tables["order_items"]) \
        .createOrReplaceTempView("order_summaries")
    R.payment_stats_view(tables["orders"], tables["payments"], as_of).createOrReplaceTempView("payment_stats")
    return names + ["order_summaries", "payment_stats"]


def register_fixture_views(spark: SparkSession, sf_dir: str, as_of=None) -> list[str]:
    """The same views over the model built from the driver tables."""
    from paytrail.sources import fixtures as fx
    from paytrail.sources.tables import RawTables
    raw = RawTables(spark, sf_dir)
    tables = {"orders": fx.model_orders(raw), "order_items": fx.model_items(raw), "payments": fx.model_payments(raw)}
    return register_views(spark, tables, as_of or fx.AS_OF)
