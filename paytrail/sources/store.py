"""Per-session store of the model tables built from the driver tables.

In production the model (orders, items, payments, ...) is stored once and
every report reads it.  The fixture adapters build it from the driver's
TPC-H-style tables; this store writes each adapted table once per Spark
application under ``spark.checkpoint.dir`` (the shared folder) and hands out
reads of the stored copy afterwards.  Tables keyed by order id are
range-clustered on it, so files cover contiguous key ranges and a table
stored as one input row group still comes back as many splits.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORES: dict[tuple[str, str], ModelStore] = {}


class ModelStore:
    def __init__(self, spark: SparkSession, sf_dir: str):
        from paytrail.session import checkpoint_root
        self.spark = spark
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:16]
        self.root = f"{checkpoint_root(spark).rstrip('/')}/model-store/{spark.sparkContext.applicationId}/{tag}"
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def for_session(cls, spark: SparkSession, sf_dir: str) -> ModelStore:
        key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
        if key not in _STORES:
            _STORES[key] = cls(spark, sf_dir)
        return _STORES[key]

    def _done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def table(self, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
        """The stored table ``name``; built with ``build()`` on first use."""
        if name in self._tables:
            return self._tables[name]
        path = f"{self.root}/{name}"
        if not self._done(path):
            df = build()
            # no fixed count: AQE sizes the files (many for big tables, few for tiny ones); a table without a key comes
            # out of a shuffle of its own, whose partitions are written as they are
            df = df.repartitionByRange(key) if key else df
            df.write.mode("overwrite").parquet(path)
        self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]

    def laid_out(self, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
        """A table that ``write`` lays out itself on first use; its files are listed once."""
        if name not in self._tables:
            path = f"{self.root}/{name}"
            if not self._done(path):
                write(path)
            self._tables[name] = read(path)
        return self._tables[name]
