"""The per-session model store builds each adapted table once."""

from conftest import SF_SMALL
from paytrail.sources import fixtures as fx
from paytrail.sources.tables import RawTables


def test_second_use_reads_the_stored_copy(spark):
    a = fx.model_orders(RawTables(spark, SF_SMALL))
    b = fx.model_orders(RawTables(spark, SF_SMALL), with_customer=False)
    assert a is b                                       # one stored table per session
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "model-store" in plan and "orders.parquet" not in plan
    direct = fx.model_orders(RawTables(spark, SF_SMALL, store=False))
    assert sorted(map(str, a.drop("metadata").collect())) == sorted(map(str, direct.drop("metadata").collect()))
