"""Scalar helpers."""

import datetime as dt

from pyspark.sql import functions as F

from paytrail.functions import ids
from paytrail.functions.money import cents_to_dollars, money_text
from paytrail.functions.text import int_param, keep_if_non_empty, long_date_text, or_empty, tracking_url


def test_ids_are_deterministic_and_shaped(spark):
    df = spark.range(3).select(ids.order_id(F.col("id")).alias("o"), ids.tracking_id(F.col("id")).alias("t"),
                               ids.event_id(F.lit("k"), F.col("id")).alias("e"))
    a, b = df.collect(), df.collect()
    assert a == b
    for r in a:
        assert r.o.startswith("ORD") and len(r.o) == 19
        assert r.t.startswith("TRK") and len(r.t) == 19 and r.t[3:] != r.o[3:]
        assert r.e.startswith("evt_") and len(r.e) == 28


def test_int_param_fallbacks():
    assert int_param(None, 50, 1) == 50
    assert int_param("", 50, 1) == 50
    assert int_param("abc", 50, 1) == 50
    assert int_param("0", 50, 1) == 50      # limit must be > 0
    assert int_param("7", 50, 1) == 7
    assert int_param("-1", 0, 0) == 0       # offset must be >= 0
    assert int_param("3", 0, 0) == 3


def test_text_helpers(spark):
    df = spark.createDataFrame([(1999, dt.datetime(2006, 1, 2, 15, 4), "", "old", "TRK1")],
                               "c long, ts timestamp_ntz, new string, old string, trk string")
    r = df.select(cents_to_dollars(F.col("c")).alias("d"), money_text(F.col("c")).alias("m"),
                  long_date_text(F.col("ts")).alias("dt"), keep_if_non_empty(F.col("new"), F.col("old")).alias("k"),
                  or_empty(F.lit(None).cast("string")).alias("e"), tracking_url(F.col("trk")).alias("u")).first()
    assert r.d == 19.99 and r.m == "19.99" and r.dt == "January 2, 2006"
    assert r.k == "old" and r.e == "" and r.u.endswith("track-order?id=TRK1")
