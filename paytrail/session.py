"""Spark session and shared-folder helpers.

The engine never picks a machine-local scratch folder on a cluster: lineage
cuts and streaming state go under ``spark.checkpoint.dir``, which the cluster
names.  Only on a ``local[...]`` master without that setting (unit tests on a
laptop) do we fall back to a fresh folder of our own; a cluster without it is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are plain Spark SQL configs.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep Catalyst's own size check for automatic broadcasts (10 MB default)
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their RDD is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "paytrail", driver_memory: str | None = None,
              extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:  # only effective before the JVM starts (local mode)
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in {**SCALE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def size_for_scale(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024,
                   max_partitions: int = 200_000) -> int:
    """Shuffle partitions for an input of ``input_bytes``.

    Starts from about ``target_partition_bytes`` per shuffle partition (so a
    partition's sort and hash buffers fit in an executor without heavy spill)
    and lets AQE coalesce the ones that come out small.  The fold uses the
    same number as its segment count, so a hot order is cut that finely.
    """
    n = max(200, min(max_partitions, -(-int(input_bytes) // target_partition_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes // 2))
    return n


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and snapshots.

    Reads ``spark.checkpoint.dir`` from the session.  Sets our own only when it
    is unset (tests), and registers it with the SparkContext so that
    ``DataFrame.checkpoint()`` works.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="paytrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint under ``spark.checkpoint.dir``.

    For rows that several branches use: they are computed once, and a lost
    executor does not recompute what is upstream of them.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package's sources to Spark for the Python workers, once per application.

    Spark's own file server delivers the archive; no task reads the driver's folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="paytrail-package-")) / "paytrail_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
