"""Registered queries: name -> (spark callable, oracle SQL body).

Each callable takes ``(spark, sf_dir)``, builds the model from the whole
driver tables and runs one operator.  The SQL body is appended to the
fixture CTEs of ``paytrail.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paytrail.plans import oracle
from paytrail.sources.tables import RawTables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[RawTables], DataFrame]) -> Callable[[RawTables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # model timestamps are TIMESTAMP_NTZ; day/month truncation must not
            # depend on the caller's session zone
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(RawTables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            oracle.register(name, sql)
        return fn
    return deco
