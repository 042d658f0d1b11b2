"""The SQL views answer like the DataFrame operators."""

from conftest import SF_SMALL
from paytrail.operators import reports as R
from paytrail.plans.views import register_fixture_views
from paytrail.sources import fixtures as fx


def test_sql_views(spark, raw):
    names = register_fixture_views(spark, SF_SMALL)
    assert set(names) == {"orders", "order_items", "payments", "order_summaries", "payment_stats"}
    stats = spark.sql("SELECT * FROM payment_stats").first().asDict()
    exp = R.payment_stats_view(fx.model_orders(raw), fx.model_payments(raw), fx.AS_OF).first().asDict()
    assert stats == exp
    n = spark.sql("SELECT count(*) AS n, sum(item_count) AS items FROM order_summaries").first()
    assert n.n == raw.orders.count() and n.items == raw.lineitem.count()
    top = spark.sql("SELECT id FROM orders ORDER BY created_at DESC, id LIMIT 3").collect()
    assert len(top) == 3
