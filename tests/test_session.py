"""Session helpers: checked broadcasts and partition sizing."""

from paytrail.operators.broadcast import broadcast_if_small, estimated_size_bytes
from paytrail.session import checkpoint_root, size_for_scale


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_under_the_limit(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(100000).withColumnRenamed("id", "k")
    assert estimated_size_bytes(small) is not None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # isolate our own decision
    try:
        hinted = big.join(broadcast_if_small(small, max_bytes=10 ** 6), "k", "left_semi")
        assert "BroadcastHashJoin" in _plan(hinted)
        refused = big.join(broadcast_if_small(small, max_bytes=1), "k", "left_semi")
        assert "BroadcastHashJoin" not in _plan(refused)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_size_for_scale(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_for_scale(spark, 10) == 200                      # floor
        assert size_for_scale(spark, 100 * 1024 ** 4) == 200_000     # 100 TB hits the cap
        assert size_for_scale(spark, 1024 ** 4) == 4096               # 1 TB / 256 MB
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4096"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_checkpoint_root_reads_the_session(spark):
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
