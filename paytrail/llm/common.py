"""Small helpers shared by the operators of this subpackage.

Shared-folder rule: everything an operator keeps between jobs goes under
``spark.checkpoint.dir`` (see :func:`paytrail.session.scratch_path`), through
Spark itself or through ``pyarrow.fs``, never through a machine-local folder.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import paytrail
from paytrail.session import scratch_path

# rows per Arrow batch: texts may be long, so a batch holds few of them
TEXT_BATCH_ROWS = 512
# bytes of one Arrow batch: rows may be packed blocks, and the JVM and the worker both hold a whole batch outside the heap
BATCH_BYTES = 8 * 1024 * 1024

# every byte that is not part of an ASCII letter, ASCII digit or non-ASCII character becomes a
# space; A-Z become a-z.  Bytes of 0x80 and above are word bytes, so UTF-8 characters stay whole.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words as UTF-8 bytes; null has none."""
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Before any Python task: bound what one Arrow batch of texts holds, and ship this package to the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship(spark)


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application, so that the driver's import path is enough.

    The archive is handed to Spark, whose file server delivers it; no task reads the driver's folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(paytrail.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="paytrail-src-")) / "paytrail_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def no_cycles() -> None:
    """In a Python worker whose task makes no reference cycles: millions of cached words would keep the cyclic collector busy."""
    gc.disable()


class WordHash:
    """64-bit hashes of words; the cache is bounded in words and, as long words are not kept, in bytes."""

    def __init__(self, limit: int = 200_000, longest: int = 64):
        self.cache: dict[bytes | str, int] = {}
        self.limit, self.longest = limit, longest

    def __call__(self, words: list) -> np.ndarray:
        cache = self.cache
        missing = set(words).difference(cache)
        if len(cache) + len(missing) > self.limit:
            cache.clear()
            missing = set(words)
        for w in missing:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        out = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        for w in missing:
            if len(w) > self.longest:
                del cache[w]
        return out


_HELD: dict[str, object] = {}


def held(key: str, build):
    """The one thing that this Python worker keeps between tasks.

    Workers are used again by later stages and operators: what another operator left is dropped before ``build`` runs.
    """
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """For tasks that keep nothing: drop what another operator left in this Python worker, and give free memory back.

    Workers are used again by all operators; the allocator would keep what the largest block of any of them once took.
    Called for every group, it gives back at most once a second.
    """
    if _HELD:
        _HELD.clear()
        gc.collect()
    _give_back()


_LIBC: list = []  # the C library and when memory was given back
TRIM_EVERY = 1.0  # seconds


def _give_back() -> None:
    if not _LIBC:
        # Arrow's buffers come from the same allocator, so that one call serves all
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            trim = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library keeps its own rules
            trim = None
        _LIBC[:] = [trim, 0.0]
    trim, at = _LIBC
    if trim is not None and time.monotonic() - at >= TRIM_EVERY:
        trim(0)
        _LIBC[1] = time.monotonic()


class Shared:
    """A value broadcast once, opened once per Python worker by ``opened`` and kept until another operator runs there.

    The caller knows a bound of the value's size.
    """

    def __init__(self, spark: SparkSession, value, opened=lambda x: x):
        self.key, self.value, self.opened = uuid.uuid4().hex, spark.sparkContext.broadcast(value), opened

    def get(self):
        return held(self.key, lambda: self.opened(self.value.value))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors."""
    return stored_at(df, scratch_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``stored`` under a path that the caller removes when nothing reads it any more."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    Catalyst may inline a projected column into a lambda that refers to it,
    which would evaluate it once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns never clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style URI (``file:/x``, ``hdfs://...``, ``s3://...``) or a path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, content: bytes, attempt: str) -> None:
    """Write a whole file under a hidden name, then move it: a killed task leaves no half file."""
    fs, path = file_system(uri)
    head, _, tail = path.rpartition("/")
    hidden = f"{head}/_{tail}.{attempt}"
    with fs.open_output_stream(hidden) as out:
        out.write(content)
    fs.move(hidden, path)


def make_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)


def remove_folder(uri: str) -> None:
    """Remove a scratch folder that this operator made and nothing reads any more."""
    fs, path = file_system(uri)
    fs.delete_dir(path)
