"""Stored model tables round-trip with their declared schemas."""

from pyspark.sql import functions as F

from paytrail.session import scratch_path
from paytrail.sources import fixtures as fx
from paytrail.sources.tables import read_model, write_model


def test_write_read_model(spark, raw):
    tables = {"orders": fx.model_orders(raw), "order_items": fx.model_items(raw), "payments": fx.model_payments(raw)}
    root = scratch_path(spark, "model")
    write_model(tables, root)
    back = read_model(spark, root)
    assert set(back) == {"orders", "order_items", "payments"}
    for name, df in tables.items():
        assert back[name].count() == df.count()
        cols = [c for c, t in back[name].dtypes if not t.startswith("map")]  # maps cannot be set-compared
        assert back[name].select(*cols).exceptAll(df.select(*cols)).count() == 0
    o = back["orders"]
    assert dict(o.dtypes)["created_at"] == "timestamp_ntz" and dict(o.dtypes)["metadata"] == "map<string,string>"
    hit = o.filter(F.col("id") == "ORD5")
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,ORD5)]" in hit._jdf.queryExecution().executedPlan().toString()
    assert hit.count() == 1
