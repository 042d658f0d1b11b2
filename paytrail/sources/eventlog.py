"""The payment-event log as a stored table (IO4).

Files lie in one folder a period (a day, or a month for logs that are thin over
many years) and batch.  A batch appends new folders and rewrites nothing else;
run again after a failure it replaces its own folders, and only these.  Readers
name the declared schema, and a range of time prunes to its periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.schemas import PAYMENT_EVENTS

DAY, MONTH = "DAY", "MONTH"
STORED = T.StructType([*PAYMENT_EVENTS.fields, T.StructField("period", T.DateType()), T.StructField("batch", T.LongType())])


def period_of(at: Column, grain: str = DAY) -> Column:
    """The folder date of a time: its day, or the first day of its month."""
    if grain not in (DAY, MONTH):
        raise ValueError(f"unknown grain {grain}")
    return F.to_date(F.date_trunc(grain, at))


def append_events(events: DataFrame, path: str, batch: int, grain: str = DAY) -> None:
    """Append one batch of ``PAYMENT_EVENTS`` rows to the log under ``path``; the same batch again replaces itself.

    Rows are dealt to the files by period, order and place in the log, so that a busy day or order is several files
    and an order's rows lie together.
    """
    rows = events.select(*PAYMENT_EVENTS.fieldNames(), period_of(F.col("created_at"), grain).alias("period"), F.lit(batch).cast("long").alias("batch"))
    (rows.repartitionByRange("period", "order_id", "seq").sortWithinPartitions("period", "order_id", "seq")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, with ``period`` and ``batch``."""
    return spark.read.schema(STORED).parquet(path)


def events_between(log: DataFrame, since, until, grain: str = DAY) -> DataFrame:
    """Events with since <= created_at < until; only the folders of these periods are read."""
    lo, hi = (F.lit(str(x)).cast("timestamp_ntz") for x in (since, until))
    inside = (F.col("period") >= period_of(lo, grain)) & (F.col("period") <= period_of(hi, grain))
    return log.filter(inside & (F.col("created_at") >= lo) & (F.col("created_at") < hi)).select(*PAYMENT_EVENTS.fieldNames())
