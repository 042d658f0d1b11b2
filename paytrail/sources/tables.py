"""Raw table access.

Each table is read lazily with ``spark.read.parquet``; Catalyst prunes the
columns a query does not use and pushes filters into the scan.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


class RawTables:
    """Driver-provided parquet tables of one scale factor.

    ``store=True`` (default) keeps the adapted model tables in a per-session
    ``ModelStore`` so each is built from the driver tables once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        if store:
            from paytrail.sources.store import ModelStore
            self.store = ModelStore.for_session(spark, sf_dir)
        else:
            self.store = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")


# ------------------------------------------------------- stored model tables ---
def model_schemas():
    from paytrail import schemas as S
    return {"orders": S.ORDERS, "order_items": S.ORDER_ITEMS, "payments": S.PAYMENTS,
            "payment_events": S.PAYMENT_EVENTS}


def write_model(tables: dict[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Store the flat model tables as parquet, each clustered by order id.

    Rows are range-partitioned on the order key before writing, so each file
    covers a contiguous key range and parquet min/max statistics let a lookup
    by id skip most files.
    """
    schemas = model_schemas()
    for name, df in tables.items():
        key = "id" if name == "orders" else "order_id"
        cols = [f.name for f in schemas[name].fields]
        out = df.select(*cols).repartitionByRange(key).sortWithinPartitions(key)
        out.write.mode(mode).parquet(os.path.join(root, name))


def read_model(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """IO1: read stored model tables with their declared schemas (no inference)."""
    out = {}
    for name, schema in model_schemas().items():
        path = os.path.join(root, name)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            out[name] = spark.read.schema(schema).parquet(path)
    return out
