"""Lookups report an existing row as found whatever other fields it lacks; provider ids; snapshot pointer."""

from pyspark.sql import functions as F

from paytrail.functions.text import provider_id
from paytrail.operators import catalogue
from paytrail.sources import sinks


def test_existing_rows_with_null_fields_are_found(spark):
    intents = spark.createDataFrame([("pi_1", None, 5)], "id string, status string, amount long")
    keys = spark.createDataFrame([("pi_1",), ("pi_2",)], "payment_intent_id string")
    got = {r.requested_id: r.found for r in catalogue.verify_payment(intents, keys).collect()}
    assert got == {"pi_1": True, "pi_2": False}


def test_expanded_provider_objects_give_their_id(spark):
    df = spark.createDataFrame([("pi_1",), ('{"id":"pi_2","amount":3}',), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(provider_id(F.col("x"))).collect()] == ["pi_1", "pi_2", "", None]


def test_snapshot_pointer_is_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    for n in (1, 2, 3):
        sinks.write_snapshot(spark.range(n), root)
        assert sinks.read_snapshot(spark, root).count() == n
