"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

File layout (little endian), one self-contained file per run of documents:

``PTTOK1\\0\\0``, four int64 (documents, ids, table length, data bytes), the document
ids (int64), their null flags (uint8), the documents' lengths (int64), the rank
table (uint32: rank -> id, most frequent first, ties by id), the control bytes
(2 bits per id: data bytes - 1, four ids to a byte) and the data bytes (ranks,
little endian).  Control and data bytes are separate, so numpy decodes a file
with one table lookup per control byte.

Documents are range-partitioned and sorted by id, each task writes its run of
files into the shared folder under names that sort in document order, and the
files are read back as Spark's ``binaryFile`` source.  A retried task writes the
same names with the same content.  The driver sees one manifest row per file.

Defined results: a null text is an empty text (only the end id); a null document
id sorts first; rows with equal ids are ordered by their text's hash and all
kept; an empty table gives no files and an empty result; other columns of the
input are not read.  A file holds at most ``file_ids`` ids or one document.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.bpe import byte_alphabet
from paytrail.llm.common import make_folder, no_cycles, pick, shuffle_partitions, small_batches, stored, write_file
from paytrail.session import scratch_path

MAGIC = b"PTTOK1\0\0"
FILE_IDS = 4_000_000
CACHE_TOKENS = 1_000_000

# fixed value: the word pattern of the vocabulary file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for a lower-case ASCII token without an apostrophe
_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall

#: control byte -> the lengths of its four ids
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def _control(codes: np.ndarray) -> bytes:
    """Four 2-bit codes to a byte."""
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = codes
    a, b, c, d = (padded[k::4] for k in range(4))
    return (a | b << 2 | c << 4 | d << 6).tobytes()


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative integers under 2**32."""
    v = values.astype(np.uint32)
    if len(v) and int(v.max()) < 1 << 16:  # one or two bytes each
        big = v > 0xFF
        keep = np.ones((len(v), 2), dtype=bool)
        keep[:, 1] = big
        return _control(big.astype(np.uint8)), v.astype("<u2").view(np.uint8).reshape(-1, 2)[keep].tobytes()
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    at = ends - size
    for b in range(4):
        has = size > b
        data[at[has] + b] = v[has] >> (8 * b) & 0xFF
    return _control((size - 1).astype(np.uint8)), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for b in range(1, int(size.max(initial=1))):
        has = size > b
        if has.any():
            out[has] |= data[at[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file's content."""
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary: count by id
        every = np.bincount(ids)
        values = np.flatnonzero(every)
        order = np.lexsort((values, -every[values]))
        rank = np.zeros(len(every), dtype=np.uint32)
        rank[values[order]] = np.arange(len(values), dtype=np.uint32)
        control, data = pack(rank[ids])
    else:
        values, ranks_of, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((values, -counts))
        rank = np.empty(len(values), dtype=np.uint32)
        rank[order] = np.arange(len(values), dtype=np.uint32)
        control, data = pack(rank[ranks_of.ravel()])
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(values), len(data)], dtype="<i8").tobytes(),
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(),
        np.array(lengths, dtype="<i8").tobytes(), values[order].astype("<u4").tobytes(), control, data,
    ])


def parse(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of one file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, ranks, size = np.frombuffer(content, "<i8", 4, 8).tolist()
    at = 40
    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out
    doc_ids, null, lengths, table = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u4", ranks)
    control, data = take("u1", -(-n // 4)), take("u1", size)
    ids = table[unpack(control, data, n)] if n else np.zeros(0, dtype=np.uint32)
    return [None if m else d for d, m in zip(doc_ids.tolist(), null.tolist(), strict=True)], lengths, ids


class _Learned(dict):
    """token -> ids; a token that is not there yet is learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, token: str) -> bytes:
        return self.learn(token)


class LibraryEncoder:
    """The tokenizers library, asked once per distinct white-space token of a batch.

    The vocabulary drops white space and no word spans it, so a text's ids are
    its tokens' ids in a row.  Texts where that could differ (special tokens, separators that are
    no Unicode white space, not NFC, a final sigma) go to the library whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(definition)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.alphabet, self.tokenize = byte_alphabet(), self.lib.model.tokenize
        # the pattern whose pieces this class cuts itself; for another one every token goes to the library
        split = (json.loads(definition).get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.cuts = split == SPLIT
        self.cache = _Learned(self.learn)

    def whole(self, text: str) -> bool:
        if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
            return True
        return any(c in text for c in "\x1c\x1d\x1e\x1f") or "<" in text and any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, word: str) -> bytes:
        """Ids of one pre-tokenized word: the library's model on its byte symbols."""
        symbols = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode("utf-8")])
        return array("I", [t.id for t in self.tokenize(symbols)]).tobytes()

    def learn(self, token: str) -> bytes:
        """Ids of a white-space token; plain words and ASCII tokens without an apostrophe are cut here."""
        cache = self.cache
        if not self.cuts or "'" in token:
            ids = self.ids(token)
        elif token.isalpha():
            ids = self.piece(token)
        elif token.isascii() or token[-1] in ".," and token[:-1].isalpha():
            parts = []
            for part in _PIECES(token) if token.isascii() else (token[:-1], token[-1]):
                if (got := cache.get(part)) is None:  # not by [], which would learn it as a token
                    got = cache[part] = self.piece(part)
                parts.append(got)
            ids = b"".join(parts)
        else:
            ids = self.ids(token)
        cache[token] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out, get = [], self.cache.__getitem__
        for t in texts:
            if len(self.cache) > CACHE_TOKENS:
                self.cache.clear()
            out.append(self.ids(t) if t and self.whole(t) else b"".join(map(get, (t or "").lower().split())))
        return out


_ENCODER: dict[str, LibraryEncoder] = {}

MANIFEST = "part int, seq int, n_docs long, n_ids long"
FILE_NAME = "tok-%07d-%07d.bin"


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 2, id_col: str = "doc_id",
                      text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text and write the id files in ascending document order; the manifest, one row per file."""
    spark = df.sparkSession
    small_batches(spark)
    make_folder(folder)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    src = pick(df, id_col, text_col).withColumn("id", F.col("id").cast("long")).withColumn("tie", F.xxhash64("text"))
    src = src.repartitionByRange(shuffle_partitions(spark), "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        no_cycles()
        if key not in _ENCODER:
            _ENCODER.clear()
            _ENCODER[key] = LibraryEncoder(shared.value)
        encode, task = _ENCODER[key], TaskContext.get()
        part, attempt, seq = task.partitionId(), str(task.taskAttemptId()), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        size = 0

        def flush():
            nonlocal docs, lengths, ids, size, seq
            write_file(f"{folder}/{FILE_NAME % (part, seq)}", file_bytes(docs, lengths, np.frombuffer(b"".join(ids), dtype="<u4")), attempt)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64())], ["part", "seq", "n_docs", "n_ids"])
            docs, lengths, ids, size, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for i, got in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                n = (len(got) + len(end)) // 4
                if docs and size + n > file_ids:
                    yield flush()
                docs.append(i)
                lengths.append(n)
                ids += [got, end]
                size += n
        if docs:
            yield flush()

    return src.mapInArrow(run, MANIFEST)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, row, doc_id, local_start, n_tokens, ids_crc32) of every document in the files of a folder."""
    schema = T.StructType([T.StructField(n, k) for n, k in (("file", T.StringType()), ("row", T.LongType()), ("doc_id", T.LongType()), ("local_start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))])
    src = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = parse(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(doc_ids), pa.string()), pa.array(np.arange(len(doc_ids)), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], schema.names)

    return src.mapInArrow(run, schema)


def token_files(df: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
                file_ids: int = FILE_IDS, folder: str | None = None) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32) per document.

    Runs the writing job.  The manifest is stored; a file's start is its place in its part plus the ids of the
    parts before (one row a part), joined by file name.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = stored(write_token_files(df, tokenizer_path, folder, end_id, id_col, text_col, file_ids), "token-manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    at = (manifest.withColumn("inside", inside).join(parts, "part")
          .select(F.format_string(FILE_NAME, "part", "seq").alias("file"), (F.col("parts_before") + F.col("inside")).alias("before")))
    out = read_token_files(spark, folder).join(at, "file")
    return out.select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
