"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z only and cut into words (ASCII letters and digits
and every non-ASCII character).  A window is ``size`` consecutive words of a
benchmark item; a shorter item that has words is one window.  Spark cuts the
benchmark into its distinct windows, stored with the items that hold them; they
are broadcast as sorted hashes and word ids.  Training words get the ids of the
windows' vocabulary (0 for any other word); numpy hashes every position whose
``size`` words are all known, looks the hash up in the sorted window hashes, and
a hit counts only when the words themselves are equal.

The sizes of the windows are added up before anything is sent: a broadcast holds
at most ``chunk_bytes`` of window text and item ids (or one window).  Windows
that fit are scanned in one pass that shuffles nothing.  Larger benchmarks take
one pass over the documents a chunk, each a job of its own that returns only the
documents with hits; these are merged by row number.

Defined results: a null or empty text has no words, no hits and is clean; an item
without words has no windows; repeated items count once per distinct item id, a
null item id stands as the empty string; repeated documents are each reported;
an empty benchmark contaminates nothing; other columns are not read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.common import Shared, pick, small_batches, stored, words_of

WINDOW = 10
CHUNK_BYTES = 64 * 2**20
_LOT_BYTES = 16 * 2**20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, words, item): the distinct windows of every item, their words joined by spaces."""
    small_batches(benchmark.sparkSession)
    src = pick(benchmark, id_col, text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    names = ["n", "words", "item"]

    def cut(batches):
        for batch in batches:
            n_words, texts, owners, held_bytes = [], [], [], 0
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.decode("utf-8") for w in words_of(text)]
                n = min(size, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    texts.append(" ".join(words[i : i + n]))
                    n_words.append(n)
                    owners.append(item)
                    held_bytes += len(texts[-1]) + len(item)
                    if held_bytes > _LOT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(n_words, pa.int32()), pa.array(texts, pa.string()), pa.array(owners, pa.string())], names)
                        n_words, texts, owners, held_bytes = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(n_words, pa.int32()), pa.array(texts, pa.string()), pa.array(owners, pa.string())], names)

    return src.mapInArrow(cut, "n int, words string, item string").distinct()


def pack(found: pa.Table) -> dict:
    """Windows as arrays: the vocabulary, per length the sorted hashes with their word ids, and the items of every window."""
    texts = found.column("words").combine_chunks().dictionary_encode()
    items = found.column("item").combine_chunks().dictionary_encode()
    code = texts.indices.to_numpy(zero_copy_only=False)
    words = pc.split_pattern(texts.dictionary.cast(pa.large_string()), " ")
    flat = words.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(1)
    ends = words.offsets.to_numpy()
    lengths, lots = np.diff(ends), {}
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        grams = ids[ends[own][:, None] + np.arange(n)]
        h = _hash(grams)
        order = np.argsort(h, kind="stable")
        lots[n] = (h[order], grams[order], own[order])
    by_window = np.argsort(code, kind="stable")
    return {"vocab": flat.dictionary, "lots": lots, "starts": np.searchsorted(code[by_window], np.arange(len(lengths) + 1)),
            "owners": items.indices.to_numpy(zero_copy_only=False)[by_window], "items": items.dictionary.to_pylist()}


class Windows:
    """Packed windows, opened in a task."""

    def __init__(self, packed: dict):
        self.vocab = {w.encode("utf-8"): i + 1 for i, w in enumerate(packed["vocab"].to_pylist())}
        self.lots, self.starts, self.owners, self.items = packed["lots"], packed["starts"], packed["owners"], packed["items"]

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(first position, length, window) of every occurrence; ids of 0 stand for other words and text ends."""
        out, known = [], np.concatenate([[0], np.cumsum(ids > 0)])
        for n, (hashes, grams, window) in self.lots.items():
            if len(ids) < n:
                continue
            spots = np.flatnonzero(known[n:] - known[:-n] == n)
            for at in np.array_split(spots, max(1, len(spots) // 200_000)):
                words = ids[at[:, None] + np.arange(n)]
                h = _hash(words)
                k = np.searchsorted(hashes, h)
                while len(at):  # a second round only where windows share a hash
                    maybe = np.flatnonzero(hashes[np.minimum(k, len(hashes) - 1)] == h)
                    maybe = maybe[k[maybe] < len(hashes)]
                    at, words, h, k = at[maybe], words[maybe], h[maybe], k[maybe]
                    same = (grams[k] == words).all(axis=1)
                    out += zip(at[same].tolist(), [n] * int(same.sum()), window[k[same]].tolist(), strict=True)
                    at, words, h, k = at[~same], words[~same], h[~same], k[~same] + 1
        return out

    def owners_of(self, window: int) -> list[str]:
        return [self.items[i] for i in self.owners[self.starts[window] : self.starts[window + 1]].tolist()]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[list[int]], list[str]]]:
        """Per text: number of words, [first word, end word) of every run of hit words, sorted items."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1  # a 0 after each text keeps windows inside it
        ids, get = np.zeros(int(lengths.sum()) + len(words), dtype=np.uint32), self.vocab.get
        for s, w in zip(starts.tolist(), words, strict=True):
            ids[s : s + len(w)] = [get(x, 0) for x in w]
        hit = np.zeros(len(ids), dtype=bool)
        which: dict[int, set[int]] = {}
        for at, n, window in self.hits(ids):
            hit[at : at + n] = True
            which.setdefault(int(np.searchsorted(starts, at, "right")) - 1, set()).add(window)
        out = []
        for d, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            own = sorted({i for w in which.get(d, ()) for i in self.owners_of(w)})
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[s : s + n].view(np.int8), [0]]))).reshape(-1, 2).tolist() if d in which else []
            out.append((n, edges, own))
        return out


def _hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), dtype=np.uint64)
    for k in range(grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _chunks(found: DataFrame, chunk_bytes: int) -> list[DataFrame]:
    """The windows in parts of at most ``chunk_bytes`` each (or one row); the sizes are added up first."""
    bytes_of = F.octet_length("words") + F.octet_length("item") + 8 * F.col("n")
    total, rows = found.agg(F.coalesce(F.sum(bytes_of), F.lit(0)), F.count("*")).first()
    n = max(1, min(rows, -(-total // chunk_bytes)))
    while n > 1:
        part = F.pmod(F.xxhash64("words", "item"), F.lit(n))
        sizes = found.groupBy(part.alias("part")).agg(F.sum(bytes_of).alias("b"), F.count("*").alias("k")).collect()  # one row a chunk
        if n >= 64 * rows or all(r.b <= chunk_bytes or r.k == 1 for r in sizes):
            return [found.filter(part == r.part) for r in sizes]
        n *= 2
    return [found]


_SPANS, _ITEMS = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())
_ARROW = (pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))


def _shared(chunk: DataFrame) -> Shared:
    """Broadcast windows; ``_chunks`` bounds their size."""
    return Shared(chunk.sparkSession, pack(chunk.toArrow()), Windows)


def _merged(keyed: DataFrame, key: str, text_col: str, chunks: list[DataFrame]) -> DataFrame:
    """(key, spans, item_ids) of the rows with hits: one job a chunk, merged by the key."""
    src = keyed.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("spans", _SPANS), T.StructField("item_ids", _ITEMS)])
    parts = []
    for chunk in chunks:
        shared = _shared(chunk)

        def find(batches, shared=shared):
            for batch in batches:
                got = [(k, x[1], x[2]) for k, x in zip(batch.column(0).to_pylist(), shared.get().scan(batch.column(1).to_pylist()), strict=True) if x[1]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), *_ARROW))], schema.names)

        parts.append(stored(src.mapInArrow(find, schema), "decontamination-hits"))
        shared.value.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    lists = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))

    def merge(batches):
        for batch in batches:
            spans = [_union(s) for s in batch.column(1).to_pylist()]
            items = [sorted(set(i)) for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW[0]), pa.array(items, _ARROW[1])], schema.names)

    return lists.mapInArrow(merge, schema).withColumnRenamed("key", key)


def _union(spans: list[list[int]]) -> list[list[int]]:
    """Runs of hit words that several chunks found, joined where they meet or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number that stays theirs: stored once."""
    key = f"row_{uuid.uuid4().hex}"
    return stored(df.withColumn(key, F.monotonically_increasing_id()), "decontamination-rows"), key


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit (words inside a window), n_items, item_ids (sorted), contaminated and
    spans ([first word, end word) of every run of hit words)."""
    small_batches(docs.sparkSession)
    src = pick(docs, id_col, text_col)
    chunks = _chunks(stored(windows(benchmark, size, item_col, item_text_col), "decontamination-windows"), chunk_bytes)
    if len(chunks) == 1:
        shared = _shared(chunks[0])
        schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("item_ids", _ITEMS)])

        def run(batches):
            for batch in batches:
                got = shared.get().scan(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), *_ARROW)))], schema.names)

        found = src.mapInArrow(run, schema)
    else:
        rows, key = _numbered(src)
        words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))), F.lit(0)).cast("long")
        n_words = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(words)
        found = (rows.select(key, "id", n_words.alias("n_words")).join(_merged(rows, key, "text", chunks), key, "left")
                 .select("id", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("item_ids", F.array().cast(_ITEMS)).alias("item_ids")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        "item_ids", (F.size("spans") > 0).alias("contaminated"), "spans")


def items_digest(item_ids):
    """Lowercase hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.concat_ws(",", item_ids), 256)


def cut_words(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the given word runs; a run goes with its words and what stands between them."""
    if not spans or not text:
        return text
    raw = text.encode("utf-8")
    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with all its columns: without contaminated rows (``mode="documents"``) or with the hit word
    runs cut out of the text (``mode="spans"``).  Row by row where the windows fit one broadcast."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode must be 'documents' or 'spans'")
    small_batches(docs.sparkSession)
    chunks = _chunks(stored(windows(benchmark, size, item_col, item_text_col), "decontamination-windows"), chunk_bytes)
    k = docs.columns.index(text_col)
    if len(chunks) > 1:
        rows, key = _numbered(docs)
        found = _merged(rows, key, text_col, chunks)
        if mode == "documents":
            return rows.join(found, key, "left_anti").drop(key)
        spans = f"spans_{key}"
        marked = rows.join(found.select(key, F.col("spans").alias(spans)), key, "left").select(*docs.columns, spans)

        def cut(batches):
            for batch in batches:
                new = pa.array([cut_words(t, s) for t, s in zip(batch.column(k).to_pylist(), batch.column(len(docs_schema)).to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == k else batch.column(i) for i in range(len(docs_schema))], docs_schema.names)

        docs_schema = docs.schema
        return marked.mapInArrow(cut, docs_schema)
    shared = _shared(chunks[0])

    def run(batches):
        for batch in batches:
            texts = batch.column(k).to_pylist()
            found = shared.get().scan(texts)
            if mode == "documents":
                yield batch.filter(pa.array([not x[1] for x in found], pa.bool_()))
            else:
                new = pa.array([cut_words(t, x[1]) for t, x in zip(texts, found, strict=True)], pa.string())
                yield batch.set_column(k, batch.schema.field(k).name, new)

    return docs.mapInArrow(run, docs.schema)
