"""Hot-key fold benchmark: segmented fold vs a per-order window.

Usage: python tools/skew_bench.py [n_ops] [hot_share]
Builds n_ops synthetic ops where one order holds ``hot_share`` of them and
the rest spread over 100,000 orders, then times (a) ``fold_order_state`` and
(b) the same status rule as one ``lag`` window over each whole order, and
reports the share of rows that lands in the largest partition of each layout.  Local only:
this measures skew handling, it is not a registered query.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from paytrail.operators.fold import fold_order_state  # noqa: E402
from paytrail.session import checkpoint_root, get_spark  # noqa: E402


def _longest_task_by_group(log_dir: str, app_id: str) -> dict[str, float]:
    """Longest task (seconds) per job group, read from the Spark event log."""
    import glob
    import json
    files = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(f) and app_id in f)
    stage_group, longest = {}, {}
    for path in files:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    group = stage_group.get(ev["Stage ID"])
                    dur = (info["Finish Time"] - info["Launch Time"]) / 1000.0
                    longest[group] = max(longest.get(group, 0.0), dur)
    return longest


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    hot = float(sys.argv[2]) if len(sys.argv) > 2 else 1 / 3
    import tempfile
    log_dir = tempfile.mkdtemp(prefix="skew-bench-events-")  # local scratch: this is a local-only tool
    spark = get_spark("local[8]", 64, app_name="skew-bench", driver_memory="16g",
                      extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                  "spark.eventLog.compress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ops_names = F.array(*[F.lit(x) for x in ("succeeded", "failed", "canceled", "checkout", "fulfill", "refund")])
    ops = (spark.range(0, n, 1, 64).select(  # many input splits, as on a cluster
        F.when(F.rand(1) < hot, F.lit("HOT")).otherwise(F.concat(F.lit("o"), (F.col("id") % 100_000).cast("string")))
        .alias("order_id"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        F.col("id").alias("event_id"),
        F.element_at(ops_names, (F.floor(F.rand(2) * 6) + 1).cast("int")).alias("op"),
        F.lit(None).cast("string").alias("set_intent"),
        F.lit(True).alias("intent_ok"))
        .checkpoint(eager=True))

    def timed(label, df):
        df.write.format("noop").mode("overwrite").save()  # warm-up run (JIT, codegen)
        spark.sparkContext.setJobGroup(label, label)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup("other", "other")
        return label, round(time.perf_counter() - t0, 2)

    res = [timed("fold, adaptive (splits only orders over the row budget)", fold_order_state(ops).state),
           timed("fold, forced range segments", fold_order_state(ops, num_segments=64).state)]
    op = F.col("op")
    kind = (F.when(op == "succeeded", "paid").when(op == "canceled", "canceled")
            .when(op == "refund", "refunded").when(op == "fulfill", "F"))
    w = Window.partitionBy("order_id").orderBy("ts", "event_id")
    naive = (ops.select("order_id", "ts", "event_id", kind.alias("kind")).filter(F.col("kind").isNotNull())
             .withColumn("prev", F.lag("kind").over(w))
             .groupBy("order_id").agg(F.count_if((F.col("kind") == "F") & (F.col("prev") == "paid")).alias("acc"),
                                      F.max_by("kind", F.struct("ts", "event_id")).alias("last")))
    res.append(timed("per-order window (whole order in one task)", naive))
    longest = _longest_task_by_group(log_dir, spark.sparkContext.applicationId)
    for label, sec in res:
        print(f"{sec:8.2f} s  {label}   (longest task {longest.get(label, 0):.2f} s)")
    # balance: share of all status rows in the largest partition of each layout
    status = ops.filter(F.col("op") != "checkout")
    total = status.count()
    by_hash = status.repartition(64, "order_id").groupBy(F.spark_partition_id().alias("p")).count()
    by_range = status.repartitionByRange(64, "order_id", "ts", "event_id") \
        .groupBy(F.spark_partition_id().alias("p")).count()
    for label, df in (("hash on order_id (per-order window)", by_hash),
                      ("range on (order_id, ts, event_id) (segments)", by_range)):
        biggest = df.agg(F.max("count")).first()[0]
        print(f"largest partition {biggest / total:6.1%} of rows  {label}")


if __name__ == "__main__":
    main()
