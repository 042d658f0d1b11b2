"""Ranked lexical search over bit-sliced Bloom signatures.

Index: documents of similar vocabulary size share a block.  A block keeps one bitmap
over its documents for every bit of a Bloom signature (a row), in several slices:
slice j holds a document's terms that occur 2^j times or more.  The AND of a term's
rows is a bitmap of all documents that may hold it (so often); it can only name too
many.  The index is a Parquet table of blocks in the shared folder and knows nothing
of the queries.

Search: a document's upper bound is the weighted sum over the slices: a term that is
seen in slice j and not in slice j + 1 counts as if it occurred 2^(j+1) - 1 times.
The documents of the highest bounds are scored exactly first; the k-th best of their
scores is a floor that the answer reaches.  Every document whose bound is not under
that floor is then scored exactly from its text, and the k best are ranked: nothing
is left out unless its bound proves it.

The terms of the queries are broadcast in lots of at most about ``LOT_TERMS`` terms;
more queries take more lots.

Defined results: a document without terms (null, empty) is not counted and never
found; a null id ranks behind all others of its score; repeated rows are each ranked;
queries are the distinct (id, text), one without terms finds nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.common import Shared, WordHash, pick, small_batches, stored, words_of

K = 50
# rows a term sets in a slice, and rows a slice has for each term of its fullest document
HASHES, BITS = 3, 12
# documents and distinct terms of a block, distinct terms that wait in a task
BLOCK_DOCS, BLOCK_TERMS, WAITING_TERMS = 4096, 500_000, 2_000_000
LOT_TERMS = 500_000
# documents scored exactly for the floor, as a multiple of k
SEEDS = 4
# keys of documents to be scored that are broadcast: 8 bytes each and their queries
BROADCAST_KEYS = 500_000
_CELLS = 32_000_000


def _row_key() -> Column:
    """Names a row by its id and text; rows of one name have one score."""
    return F.xxhash64("id", "text").alias("row")


def _rows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """(terms, HASHES) signature rows of term hashes."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(width)).astype(np.int64)


class Waiting:
    """Documents of one block in the making: (id, row key, terms with repeats, term hashes, occurrences)."""

    def __init__(self):
        self.docs, self.terms = [], 0

    def add(self, doc: tuple) -> None:
        self.docs.append(doc)
        self.terms += len(doc[3])

    def block(self) -> tuple:
        """ids, row keys, n, widths and bitmaps of the slices, highest occurrence."""
        ids, rows, n, hashes, counts = zip(*self.docs, strict=True)
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        term, often = np.concatenate(hashes), np.concatenate(counts)
        widths, maps, least = [], [], 1
        while len(term):
            width = 64 * math.ceil(BITS * int(np.bincount(owner).max()) / 64)
            bits = np.zeros((width, 8 * math.ceil(len(ids) / 8)), dtype=bool)
            bits[_rows_of(term, width), owner[:, None]] = True
            widths.append(width)
            maps.append(np.packbits(bits, axis=1).tobytes())
            least *= 2
            keep = often >= least
            owner, term, often = owner[keep], term[keep], often[keep]
        return list(ids), list(rows), list(n), widths, maps, int(max(c.max() for c in counts))


BLOCK = "rows array<long>, n array<int>, widths array<int>, maps array<binary>, top int"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored blocks: (ids, rows, n, widths, maps, top).  No shuffle: a task cuts its own documents into blocks."""
    src = pick(docs, id_col, text_col).select("id", "text", _row_key())
    small_batches(docs.sparkSession)
    id_type = src.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string(BLOCK).fields])

    def run(batches):
        hasher, waiting = WordHash(), {}

        def done(size: int):
            ids, rows, n, widths, maps, top = waiting.pop(size).block()
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_arrow)), pa.array([rows], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())), pa.array([widths], pa.list_(pa.int32())),
                 pa.array([maps], pa.list_(pa.binary())), pa.array([top], pa.int32())], ["ids", "rows", "n", "widths", "maps", "top"])

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for i, text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                terms, counts = np.unique(hasher(words), return_counts=True)
                size = (len(terms) - 1).bit_length()
                own = waiting.setdefault(size, Waiting())
                own.add((i, row, len(words), terms, counts))
                if len(own.docs) >= BLOCK_DOCS or own.terms >= BLOCK_TERMS:
                    yield done(size)
                elif sum(w.terms for w in waiting.values()) > WAITING_TERMS:
                    yield done(max(waiting, key=lambda s: waiting[s].terms))
        for size in list(waiting):
            yield done(size)

    return stored(src.mapInArrow(run, schema), "ranked-index")


class Lot:
    """Some queries: their words, each query's word places, and after the count their weights."""

    def __init__(self, queries: list[tuple[object, list[bytes]]]):
        self.ids = [q for q, _ in queries]
        self.words = sorted({w for _, ws in queries for w in ws})
        place = {w: i for i, w in enumerate(self.words)}
        self.terms = [np.array(sorted(place[w] for w in set(ws)), dtype=np.int64) for _, ws in queries]
        self.weights = np.zeros(len(self.words), dtype=np.int64)
        self.documents = self.length = 0

    def weigh(self, documents: int, length: int, held: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        for i in range(len(self.words)):
            self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1)))

    def damping(self, n: np.ndarray) -> np.ndarray:
        """m of documents of ``n`` terms."""
        return 50 + (50 * n * self.documents) // self.length


class Opened:
    """A lot in a Python worker."""

    def __init__(self, lot: Lot):
        self.lot = lot
        self.hashes = WordHash(len(lot.words) + 1)(lot.words)
        self.scored = [[(lot.words[t], int(lot.weights[t])) for t in ts.tolist()] for ts in lot.terms]
        self.place = {w: i for i, w in enumerate(lot.words)}

    def bounds(self, n: np.ndarray, widths: list[int], maps: list[bytes], top: int) -> np.ndarray:
        """(queries, documents) upper bounds of a block."""
        lot, many = self.lot, len(n)
        out = np.zeros((len(lot.terms), many), dtype=np.int64)
        m = lot.damping(n)
        step = max(1, _CELLS // (8 * math.ceil(many / 8)))
        # the queries' words in parts, so that a part's bitmaps stay small
        for low in range(0, len(lot.words), step):
            part = slice(low, low + step)
            hashes, weights = self.hashes[part], lot.weights[part].astype(np.float64)
            inside = [ts[np.searchsorted(ts, low) : np.searchsorted(ts, low + step)] - low for ts in lot.terms]
            held, before = None, np.zeros(many, dtype=np.int64)
            for j, (width, raw) in enumerate(zip(widths, maps, strict=True)):
                rows = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
                at = _rows_of(hashes, width)
                found = rows[at[:, 0]]
                for k in range(1, HASHES):
                    found = found & rows[at[:, k]]
                held = found if held is None else held & found
                if not held.any():
                    break
                seen = np.unpackbits(held, axis=1)[:, :many]
                often = np.minimum(min(2 ** (j + 1) - 1, top), n)
                value = (1_000_000_000 * often) // (1000 * often + 20 * m)
                for q, ts in enumerate(inside):
                    if len(ts):
                        # sums of weights stay far under 2^53: exact in doubles
                        out[q] += (weights[ts] @ seen[ts]).astype(np.int64) * (value - before)
                before = value
        return out

    def scores(self, text: str | None, queries: list[int]) -> list[int]:
        """Exact scores of a whole text."""
        words = words_of(text)
        held = Counter(w for w in words if w in self.place)
        m = int(self.lot.damping(np.array([len(words)], dtype=np.int64))[0])
        value = {w: (1_000_000_000 * c) // (1000 * c + 20 * m) for w, c in held.items()}
        return [sum(x * value[w] for w, x in self.scored[q] if w in value) for q in queries]


def _lots(queries: DataFrame, id_col: str, text_col: str, lot_terms: int) -> list[Lot]:
    """The distinct queries in lots whose size is checked before they reach the driver."""
    src = pick(queries, id_col, text_col).distinct()
    cut = lambda batches: (pa.RecordBatch.from_arrays(
        [b.column(0), pa.array([sorted(set(words_of(t))) for t in b.column(1).to_pylist()], pa.list_(pa.binary())), b.column(2)], ["id", "words", "row"]) for b in batches)
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("row", T.LongType())])
    cut_up = stored(src.select("id", "text", _row_key()).mapInArrow(cut, schema).filter(F.size("words") > 0), "ranked-queries")
    total = cut_up.agg(F.sum(F.size("words"))).first()[0] or 0
    many = math.ceil(total / lot_terms)
    out = []
    for i in range(many):
        rows = cut_up.filter(F.pmod("row", F.lit(many)) == i).select("id", "words").collect() if many > 1 else cut_up.select("id", "words").collect()
        if rows:
            out.append(Lot([(r.id, list(map(bytes, r.words))) for r in rows]))
    return out


def _count(docs: DataFrame, lot: Lot) -> None:
    """Documents, their terms and, of each word of the lot, the documents that hold it; the lot's weights from these."""
    shared = Shared(docs.sparkSession, frozenset(lot.words))
    place = {w: i for i, w in enumerate(lot.words)}

    def run(batches):
        words_in, held, documents, length = shared.get(), Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if words:
                    documents += 1
                    length += len(words)
                    held.update(words_in.intersection(words))
        words = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([None, b"", *words], pa.binary()), pa.array([documents, length, *(held[w] for w in words)], pa.int64())], ["word", "c"])

    # null: documents, empty: all terms; one row a word of the lot reaches the driver
    sums = {None if r.word is None else bytes(r.word): r.c for r in docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).collect()}
    lot.weigh(sums.get(None, 0), sums.get(b"", 0), {place[w]: c for w, c in sums.items() if w})


def _exact(docs: DataFrame, wanted: DataFrame, shared: Shared) -> DataFrame:
    """(query, id, score) of the (query, row) that are wanted, from whole texts; only scores above 0."""
    keys = stored(wanted.groupBy("row").agg(F.collect_set("query").alias("queries")), "ranked-wanted")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    src = docs.join(F.broadcast(keys) if few else keys, "row").select("id", "text", "queries")
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.LongType())])

    def run(batches):
        lot = shared.get()
        for batch in batches:
            place, query, score = [], [], []
            for i, (text, queries) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for q, s in zip(queries, lot.scores(text, queries), strict=True):
                    if s > 0:
                        place.append(i)
                        query.append(q)
                        score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), batch.column(0).take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], ["query", "id", "score"])

    return src.mapInArrow(run, schema)


def _best(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _seeds(index: DataFrame, shared: Shared, many: int) -> DataFrame:
    """(query, row): at least the ``many`` rows of the highest bounds of each query."""
    def run(batches):
        lot, kept = shared.get(), {}
        for batch in batches:
            for block in batch.to_pylist():
                n, rows = np.array(block["n"], dtype=np.int64), np.array(block["rows"], dtype=np.int64)
                for q, b in enumerate(lot.bounds(n, block["widths"], block["maps"], block["top"])):
                    some = np.flatnonzero(b > 0)
                    if len(some):
                        old = kept.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        bound, row = np.r_[old[0], b[some]], np.r_[old[1], rows[some]]
                        top = np.argpartition(-bound, many - 1)[:many] if len(bound) > many else slice(None)
                        kept[q] = (bound[top], row[top])
        for q, (bound, row) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(row), pa.int32()), pa.array(row, pa.int64()), pa.array(bound, pa.int64())], ["query", "row", "bound"])

    found = index.select("rows", "n", "widths", "maps", "top").mapInArrow(run, "query int, row long, bound long")
    by = Window.partitionBy("query").orderBy(F.desc("bound"), "row")
    return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= many).select("query", "row")


def _possible(index: DataFrame, shared: Shared, floors: dict[int, int]) -> DataFrame:
    """(query, row) whose bound is not under the query's floor."""
    floor = {q: max(1, s) for q, s in floors.items()}

    def run(batches):
        lot = shared.get()
        for batch in batches:
            query, row = [], []
            for block in batch.to_pylist():
                rows = np.array(block["rows"], dtype=np.int64)
                bounds = lot.bounds(np.array(block["n"], dtype=np.int64), block["widths"], block["maps"], block["top"])
                for q, b in enumerate(bounds):
                    some = rows[b >= floor.get(q, 1)]
                    query.append(np.full(len(some), q, dtype=np.int32))
                    row.append(some)
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(row))], ["query", "row"])

    return index.select("rows", "n", "widths", "maps", "top").mapInArrow(run, "query int, row long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
           query_id_col: str = "item_id", query_text_col: str = "text", lot_terms: int = LOT_TERMS) -> DataFrame:
    """(query id, rank, doc id, score): each query's ``k`` best documents.  ``index`` is that of these documents, built here if not given."""
    small_batches(docs.sparkSession)
    if index is None:
        index = build_index(docs, id_col, text_col)
    src = pick(docs, id_col, text_col)
    src = src.select("id", "text", _row_key())
    spark, id_type, query_type = docs.sparkSession, src.schema["id"].dataType, queries.schema[query_id_col].dataType
    schema = T.StructType([T.StructField(query_id_col, query_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for lot in _lots(queries, query_id_col, query_text_col, lot_terms):
        _count(src, lot)
        if not lot.documents:
            continue
        shared = Shared(spark, lot, Opened)
        seeds = _best(_exact(src, _seeds(index, shared, SEEDS * k), shared), k)
        # one row a query reaches the driver: the k-th best score known so far
        floors = {r.query: r.floor for r in seeds.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("c")).filter(F.col("c") == k).collect()}
        best = _best(_exact(src, _possible(index, shared, floors), shared), k)
        names = spark.createDataFrame(list(enumerate(lot.ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("name", query_type)]))
        out = out.unionAll(best.join(F.broadcast(names), "query").select(F.col("name").alias(query_id_col), "rank", F.col("id").alias(id_col), "score"))
    return out
