"""The stored order requests."""

import json

from paytrail.sources import fixtures as fx
from paytrail.sources.tables import RawTables


def test_requests_are_built_without_storing_the_items(spark, tmp_path):
    """One document an order row; its lines in order, also with null and repeated keys; no other table is written for it."""
    spark.createDataFrame([(1, 5, "1-URGENT"), (2, 6, "5-LOW"), (53, 7, None), (97, 8, "5-LOW"), (2, 9, "5-LOW"), (None, 1, "x")],
                          "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 10, 7, 3.0), (1, 11, 1, 4.0), (1, 99, 2, 4.0), (2, 10, 1, 1.0), (2, 10, 1, 1.0), (None, 10, 1, 1.0), (3, 10, 1, 1.0)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, "ten", "T"), (11, "eleven", "E")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    raw = RawTables(spark, str(tmp_path))
    got = sorted(((r.request_key, r.payload) for r in fx.order_requests(raw).collect()), key=repr)
    assert [k for k, _ in got] == [1, 2, 2, 53, 97, None]
    ten = {"product_id": "prod_10", "product_name": "ten", "file_type": "T", "price": 1.69}
    eleven = {"product_id": "prod_11", "product_name": "eleven", "file_type": "E", "price": 1.76}
    first = json.loads(got[0][1])
    assert first["items"] == [{**eleven, "quantity": 4}, {**ten, "quantity": 0}] and first["customer_info"] == {"email": "c5@example.com"}
    assert json.loads(got[1][1])["items"] == [{**ten, "quantity": 1}] * 2 == json.loads(got[2][1])["items"]
    assert json.loads(got[3][1])["items"] == [] and json.loads(got[3][1])["customer_info"] == {"email": ""}
    assert not got[4][1].endswith("}") and json.loads(got[5][1])["items"] == []
    assert set(raw.store._tables) == {"order_requests"}
