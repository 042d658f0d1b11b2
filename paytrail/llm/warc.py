"""WARC records in ZIP packages, read back by byte ranges.

A package is a ZIP file with two stored (not compressed) members:
``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj``
(one line per record: key, then JSON with offset and length).  A package is
closed at ``package_bytes``; sizes or offsets of 4 GB and more (or
``zip64=True``) use the ZIP64 records.

The reader takes the end record, the ZIP64 locator where there is one, the
central directory and the members' local headers, then reads the index and only
the byte ranges of the records asked for.  Nothing is extracted to disk.

Equal payloads: of the records whose payload has at least ``min_bytes`` bytes,
the one with the smallest id (a null id is the largest) is a response and the
others are revisits of it; smaller payloads are all responses.  Smallest ids are
found by a partial aggregate over (digest, length); only digests that occur
twice or more are joined back, spread over salts.

Defined results: a null payload is an empty one; rows that repeat the smallest id
of a payload are all responses; an empty table writes no package and reads
as an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.common import file_system, make_folder, small_batches, write_file
from paytrail.session import scratch_path

PACKAGE_BYTES = 32 << 20
SALTS = 32
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_AHEAD = 1 << 20


# ---- ZIP ------------------------------------------------------------------------------------------

def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members, with ZIP64 records where needed or asked for."""
    out, directory, at = [], [], 0
    for name, content in members:
        raw, n, crc = name.encode("utf-8"), len(content), zlib.crc32(content)
        big = zip64 or n >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, *(2 * (0xFFFFFFFF if big else n,)), len(raw), len(extra))
        far = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, *(2 * (0xFFFFFFFF if big else n,)), len(raw), len(far), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + far)
        out += [local, raw, extra, content]
        at += len(local) + len(raw) + len(extra) + n
    central, count = b"".join(directory), len(members)
    end = b""
    if zip64 or at >= 0xFFFFFFFF or count >= 0xFFFF:
        end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(central), at)
        end += struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
        end += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, len(central), at, 0)
    return b"".join([*out, central, end])


class ZipRanges:
    """Finds the stored members of a ZIP file through ranged reads of a seekable file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self.read(max(0, size - 65557), min(size, 65557))
        k = tail.rfind(b"PK\5\6")
        if k < 0:
            raise ValueError("not a ZIP file: no end record")
        count, length, start = struct.unpack_from("<HII", tail, k + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            where = max(0, size - len(tail)) + k - 20
            mark, _, record, _ = struct.unpack("<4sIQI", self.read(where, 20))
            if mark != b"PK\6\7":
                raise ValueError("ZIP64 locator is missing")
            mark, count, length, start = struct.unpack("<4s28xQQQ", self.read(record, 56))
            if mark != b"PK\6\6":
                raise ValueError("ZIP64 end record is missing")
        self.members: dict[str, tuple[int, int]] = {}
        central, p = self.read(start, length), 0
        for _ in range(count):
            mark, method, packed, full, a, b, c, at = struct.unpack_from("<4s6xH8xIIHHH8xI", central, p)
            if mark != b"PK\1\2":
                raise ValueError("central directory is damaged")
            name, q, stop = central[p + 46 : p + 46 + a].decode("utf-8"), p + 46 + a, p + 46 + a + b
            while q + 4 <= stop:  # ZIP64 field: only the values that do not fit, in this order
                kind, n = struct.unpack_from("<HH", central, q)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{n // 8}Q", central, q + 4))
                    full, packed, at = (next(values) if x == 0xFFFFFFFF else x for x in (full, packed, at))
                q += 4 + n
            if method != 0 or packed != full:
                raise ValueError(f"{name} is not a stored member")
            self.members[name] = (at, full)
            p = stop + c

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte, length) of a member's content."""
        at, n = self.members[name]
        mark, a, b = struct.unpack("<4s22xHH", self.read(at, 30))
        if mark != b"PK\3\4":
            raise ValueError(f"local header of {name} is damaged")
        return at + 30 + a + b, n


# ---- WARC -----------------------------------------------------------------------------------------

def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _urn(record_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record/{record_id}')}>"


def record_bytes(kind: str, record_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record.  A revisit has no block but the digest and length of the full payload."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {json.dumps(record_id)}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Key: {json.dumps(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def mark_revisits(src: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload) -> adds kind and refers_to.

    The row that stays a response is the one with the smallest id of its payload.  The wide rows meet only the groups of two rows or more; a group's
    one row is copied to ``SALTS`` salts so that a frequent payload is spread.
    """
    src = src.withColumn("payload", F.coalesce(F.col("payload"), F.lit("").cast("binary")))
    src = src.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    groups = (src.filter(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
              .filter("rows > 1").select("sha1", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = src.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    return salted.join(groups, ["sha1", "n", "salt"], "left").select(
        "id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first.id")).alias("refers_to"))


def write_packages(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> int:
    """Write every row as a record; the number of packages.  Runs the job."""
    spark = df.sparkSession
    small_batches(spark)
    make_folder(folder)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(payload_col).cast("string").cast("binary").alias("payload"))
    joined = mark_revisits(src, min_bytes).select("id", "url", "payload", "kind", "refers_to")

    def run(batches):
        task, seq, data, index, at = TaskContext.get(), 0, [], [], 0

        def flush():
            nonlocal seq, data, index, at
            content = zip_bytes([(DATA, b"".join(data)), (INDEX, "".join(sorted(index)).encode("utf-8"))], zip64)
            write_file(f"{folder}/pages-{task.partitionId():07d}-{seq:07d}.zip", content, str(task.taskAttemptId()))
            data, index, at, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["packages"])

        for batch in batches:
            for i, url, payload, kind, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                body = payload or b""
                raw = _gzip(record_bytes(kind, i, " ".join(url.split()), body, digest32(body), refers))
                if data and at + len(raw) > package_bytes:
                    yield flush()
                index.append(f"{'' if i is None else f'{i:020d}'} {json.dumps({'offset': at, 'length': len(raw), 'type': kind})}\n")
                data.append(raw)
                at += len(raw)
        if data:
            yield flush()

    return joined.mapInArrow(run, "packages long").agg(F.sum("packages")).first()[0] or 0


READ = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def package_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a package, through its index; neighbouring ranges share a read."""
    package = ZipRanges(file)
    base, _ = package.locate(DATA)
    where, n = package.locate(INDEX)
    entries = sorted((e["offset"], e["length"]) for line in package.read(where, n).decode("utf-8").splitlines() for e in [json.loads(line.split(" ", 1)[1])])
    k = 0
    while k < len(entries):
        start, stop, first = entries[k][0], sum(entries[k]), k
        while k + 1 < len(entries) and entries[k + 1][0] == stop and sum(entries[k + 1]) - start <= READ_AHEAD:
            k += 1
            stop = sum(entries[k])
        raw = package.read(base + start, stop - start)
        for at, length in entries[first : k + 1]:
            yield parse_record(zlib.decompress(raw[at - start : at - start + length], 31))
        k += 1


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every record; responses are digested anew."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                out: list[tuple] = []
                with fs.open_input_file(name) as file:
                    for head, payload in package_records(file):
                        kind, key = head["WARC-Type"], json.loads(head["X-Record-Key"])
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            if said != digest32(payload) or len(payload) != int(head["X-Payload-Length"]):
                                raise ValueError(f"record {key} of {path} is damaged")
                            out.append((key, len(payload), said, kind, None))
                        else:
                            out.append((key, int(head["X-Payload-Length"]), said, kind, json.loads(head["X-Refers-To-Key"])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], READ.names)

    return files.mapInArrow(run, READ)


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                    package_bytes: int = PACKAGE_BYTES, zip64: bool = False, folder: str | None = None) -> DataFrame:
    """Write the packages, then read them: one row per record."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_packages(df, folder, id_col, url_col, payload_col, min_bytes, package_bytes, zip64)
    return read_packages(spark, folder).withColumnRenamed("id", id_col)
