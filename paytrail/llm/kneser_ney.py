"""Quality classifier: interpolated modified Kneser-Ney n-gram perplexity.

Training (all trusted rows outside fold 0, equal texts once): the n-grams of up to ``order`` words are keyed by
64-bit hashes and counted in hash shards, one level after the other, in rows packed as in ``backoff``:

1. the texts' words are stored in blocks of at most ``BLOCK_WORDS`` words, a file each; a block sends each shard its
   distinct n-grams of the highest order with their counts, and the shard adds them up;
2. the shard tells every block the totals of its n-grams and names one block the owner of each: an n-gram is one
   kind, whatever number of blocks hold it.  The owner adds it to its two (n-1)-grams: one more word before the last
   n - 1 words (the continuation count, the count of the next level), and one more word of that count after the first
   n - 1 (the sums and discount masses of contexts).  These go to the shards of the next level, down to single words.

The shards of all levels are the model, a stored file each; it grows with the training text and is never in one place.
The blocks and their answers are removed when it is whole.  Counts of counts give the three discounts of each order.

Scoring: in ``LOTS`` lots of documents, so that what is under way stays a part of the input, blocks send the shards the
distinct n-grams of every whole text, the shards answer with the counts, and the block sums the log probabilities per
document.  A word outside the model gets the interpolated uniform share.  Perplexity is the exponential of the mean
negative log probability.

Threshold: per language, the ``quantile`` of the perplexities of all trusted rows
outside the training fold (of all trusted rows where a language has none there);
it is drawn towards the quantile over all languages by ``PRIOR_ROWS`` rows, and a language
without trusted rows has that quantile itself.  One rule holds at every size.  A short
text is drawn towards its language's mean by ``PRIOR_WORDS`` words, as its own
mean says little.  Quantiles use Spark's mergeable summaries over all such rows.

Defined results: a null or empty text has no words, perplexity null and is kept;
a null language is a language of its own; rows without a label are scored but
never trained on; without trusted rows every document is kept; repeated rows are
each reported; other columns are not read. 
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.llm.backoff import _cuts, _pack_counts, _pack_sorted, _unpack_counts, _unpack_sorted
from paytrail.llm.common import WordHash, file_system, make_folder, pick, release, remove_folder, shuffle_partitions, small_batches, stored, stored_at, write_file
from paytrail.operators.broadcast import broadcast_if_few, estimated_size_bytes
from paytrail.session import scratch_path

ORDER = 3
BLOCK_WORDS = 1_000_000
# a shard for so many words of the training text at least, for so many bytes of documents to be scored, and none for fewer words
SHARD_WORDS, SHARD_BYTES, FEW_WORDS = 500_000, 32 * 1024 * 1024, 50_000
MOST_TASKS = 10_000
# documents are scored in so many lots, one after the other; stored ones of few bytes in fewer
LOTS = 16
LOT_BYTES = 16 * 1024 * 1024
QUANTILE = 0.995
PRIOR_WORDS = 20
# trusted rows over all languages that a language's own rows are weighed against
PRIOR_ROWS = 200
ALL = ("all languages",)  # the key of their limits; no language is a tuple
SHARDS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xA0761D6478BD642F)


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of its context (the words before) and its last word's hash."""
    h = (h ^ (w + _MIX + (h << np.uint64(6)) + (h >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, hashes of all words)."""
    words = [(t or "").split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    return counts, np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), dtype=np.uint64, count=int(counts.sum()))


def _grams(counts: np.ndarray, flat: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(grams[n] = the key of the n words that end at each place, the places of the words).

    Texts start with ``order - 1`` start marks, which have places too.  The words before a word end one place earlier.
    """
    pad = order - 1
    where = np.arange(len(flat)) + np.repeat(pad * np.arange(1, len(counts) + 1), counts)
    size = len(flat) + pad * len(counts)
    h = np.full(size + order, _START, dtype=np.uint64)
    h[where + order] = flat
    out = []
    for n in range(order + 1):
        key = np.full(size, np.uint64(n), dtype=np.uint64)
        for back in range(n - 1, -1, -1):
            key = _mix(key, h[order - back : order - back + size])
        out.append(key)
    return out, where


def contexts(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words per text, keys[n] = the key of the n words that end at each word, ctx[n] = the key of the n words before it)."""
    counts, flat = _hashes(texts)
    grams, where = _grams(counts, flat, order)
    return counts, [g[where] for g in grams], [np.zeros_like(flat)] + [g[where - 1] for g in grams[1:order]]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is faster than ``np.unique``, which hashes."""
    s = np.sort(x)
    return s[np.concatenate([np.ones(min(1, len(s)), dtype=bool), s[1:] != s[:-1]])]


def _distinct_back(x: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, index of a place of each, with ``first`` its first one, index into the distinct values)."""
    by = np.argsort(x, kind="stable" if first else None)
    s = x[by]
    new = np.concatenate([np.ones(min(1, len(s)), dtype=bool), s[1:] != s[:-1]])
    back = np.empty(len(x), dtype=np.int64)
    back[by] = np.cumsum(new) - 1
    return s[new], by[new], back


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts; half the count where the estimate
    leaves (0, count), as repeated texts can make it: a discount of 0 would leave unseen words no chance."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    raw = [i - (i + 1) * y * b / a if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [x if 0.0 < x < i else i / 2 for i, x in enumerate(raw, 1)]


# ---------------------------------------------------------------- packed rows ---
# a row between blocks and shards: level 0 holds a block's words (``keys``) and its documents' rows (``cols``); the others
# n-grams of ``level`` words, as sorted keys or in the order of the keys that the block sent, with columns of counts;
# the model's own rows have block -1
PIECE = "block long, level int, shard int, size long, keys binary, cols array<binary>"
_PIECE = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("shard", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("cols", pa.list_(pa.binary()))])
MODEL = -1


def _pieces(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECE)], schema=_PIECE)


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(f.name).to_pylist() for f in _PIECE), strict=True))


def _dump(counts: np.ndarray, flat: np.ndarray) -> bytes:
    """A block's words: lengths, distinct hashes and the words as numbers of these, by byte planes."""
    known, _, code = _distinct_back(flat)
    head = np.array([len(counts), len(flat), len(known)], dtype="<i8").tobytes()
    planes = code.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + counts.astype("<i8").tobytes() + planes + _pack_sorted(known))


def _load(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    docs, n, distinct = np.frombuffer(raw, "<i8", 3).tolist()
    counts, at = np.frombuffer(raw, "<i8", docs, 24), 24 + 8 * docs
    planes, at = np.frombuffer(raw, "u1", 4 * n, at), at + 4 * n
    known = _unpack_sorted(raw[at:], distinct)
    return counts, known[np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()]


def _blocks(batches, block_words: int, text_at: int = 0):
    """(block number, its rows without the text, words per text, hashes of all words) of a task's rows."""
    release()
    part, seq = TaskContext.get().partitionId(), 0
    rows, counts, flat, n = [], [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):  # texts may be long
            few = batch.slice(start, 64)
            c, h = _hashes(few.column(text_at).to_pylist())
            if rows and n + len(h) > block_words:
                yield part << 20 | seq, pa.Table.from_batches(rows), np.concatenate(counts), np.concatenate(flat)
                rows, counts, flat, n, seq = [], [], [], 0, seq + 1
            rows.append(few.select([i for i in range(few.num_columns) if i != text_at]))
            counts.append(c)
            flat.append(h)
            n += len(h)
    if rows:
        yield part << 20 | seq, pa.Table.from_batches(rows), np.concatenate(counts), np.concatenate(flat)


def _to_shards(block: int, level: int, keys: np.ndarray, cols: list[np.ndarray], shards: int) -> list[tuple]:
    """Sorted keys and their columns, one row a shard."""
    cuts = _cuts(keys, shards).tolist()
    return [(block, level, s, b - a, _pack_sorted(keys[a:b]), [_pack_counts(c[a:b]) for c in cols])
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _together(rows: list[tuple], cols: int) -> list[np.ndarray]:
    """A block's answers of one level, in the order of its keys."""
    rows = sorted(rows, key=lambda r: r[2])
    return [np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack_counts(r[5][i]) for r in rows)]) for i in range(cols)]


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Within it, Spark removes the shuffle files of every finished job: what the next one needs is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


# -------------------------------------------------------------------- training ---
def _climb(counts: np.ndarray, flat: np.ndarray, order: int, answers: dict) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """(level, distinct keys, columns) that a block sends next, after the ``answers`` (totals, owned) of higher levels.

    The highest level has one column, the count.  The lower ones have the continuation count, the kinds of n-grams that
    begin with these words and have count 1, 2, or 3 and more, and the sum of their counts.
    """
    grams, where = _grams(counts, flat, order)
    level = order
    own, at, back = _distinct_back(grams[order][where])
    at = where[at]
    cols = [np.bincount(back, minlength=len(own))]
    while level in answers:
        total, owned = answers[level]
        if len(total) != len(own):
            raise ValueError("the answers are not those of this block")
        owned = owned > 0
        here, c = at[owned], total[owned]
        level -= 1
        k = len(here)
        own, first, back = _distinct_back(np.concatenate([grams[level][here], grams[level][here - 1]]), first=True)
        size = len(own)
        ends, begins = back[:k], back[k:]
        cols = [np.bincount(ends, minlength=size), *(np.bincount(begins[x], minlength=size) for x in (c == 1, c == 2, c > 2)),
                np.bincount(begins, weights=c, minlength=size).astype(np.int64)]
        # where such words end; those that only begin an n-gram have no owner
        at = here[np.where(first < k, first, 0)] if k else first
    return level, own, cols


def _model_file(root: str, level: int, shard: int) -> str:
    return f"{root}/{level}-{shard}"


def _read(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def _read_shard(root: str, level: int, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted keys, columns) of a stored shard."""
    fs, path = file_system(_model_file(root, level, shard))
    with fs.open_input_file(path) as f, pa.ipc.open_stream(f) as r:
        row = _rows(r.read_all())[0]
    return _unpack_sorted(row[4], row[3]), [_unpack_counts(c) for c in row[5]]


def _add_up(table: pa.Table, root: str) -> pa.Table:
    """A shard of one level, stored: every block's totals and what it owns, and as the model's row the kinds with count
    1, 2, 3 and 4, all kinds, and the sum of counts."""
    release()
    rows = _rows(table)
    level, shard = rows[0][1], rows[0][2]
    known, _, back = _distinct_back(np.concatenate([_unpack_sorted(r[4], r[3]) for r in rows]))
    cols = [np.concatenate([_unpack_counts(r[5][i]) for r in rows]) for i in range(len(rows[0][5]))]
    sums = []
    for c in cols:
        total = np.zeros(len(known), dtype=np.int64)
        np.add.at(total, back, c)
        sums.append(total)
    # the first block that counted a key owns it
    counted = np.flatnonzero(cols[0] > 0)
    owned = np.zeros(len(back), dtype=np.int64)
    owned[counted[_distinct_back(back[counted], first=True)[1]]] = 1
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PIECE) as out:
        out.write_table(_pieces([(MODEL, level, shard, len(known), _pack_sorted(known), [_pack_counts(c) for c in sums])]))
    write_file(_model_file(root, level, shard), sink.getvalue().to_pybytes(), str(TaskContext.get().taskAttemptId()))
    seen = [*(int((sums[0] == i).sum()) for i in (1, 2, 3, 4)), int((sums[0] > 0).sum()), int(sums[0].sum())]
    answers = [(MODEL, level, shard, len(known), np.array(seen, dtype="<i8").tobytes(), [])]
    for r, end in zip(rows, np.cumsum([r[3] for r in rows]).tolist(), strict=True):
        answers.append((r[0], level, shard, r[3], b"", [_pack_counts(sums[0][back[end - r[3] : end]]), _pack_counts(owned[end - r[3] : end])]))
    return _pieces(answers)


class Model:
    """The stored shards of all levels, with the discounts of every order and the number of words.

    ``shards`` is how many ranges of the keys there are, ``present`` the (level, shard) that hold any; ``first`` is the sum
    of counts and the discount mass of the empty context.
    """

    def __init__(self, order: int, root: str, shards: int, present: list[tuple[int, int]], discounts: dict, first: tuple[int, float], vocabulary: int):
        self.order, self.root, self.shards, self.present = order, root, shards, frozenset(present)
        self.discounts, self.first, self.vocabulary = discounts, first, vocabulary


def train_model(texts: DataFrame, order: int = ORDER, block_words: int = BLOCK_WORDS, shards: int | None = None, asked_bytes: int = 0) -> Model:
    """The model of (text); ``asked_bytes`` is about the stored size of the documents that it will score."""
    spark = texts.sparkSession
    small_batches(spark)

    made = [scratch_path(spark, "kn-words"), scratch_path(spark, "kn-blocks")]
    make_folder(made[0])

    def cut(batches):
        # every level reads the blocks' words where they were written once: only their file names are shuffled
        attempt = str(TaskContext.get().taskAttemptId())
        for number, _, counts, flat in _blocks(batches, block_words):
            name = f"{made[0]}/{number}-{attempt}"
            write_file(name, _dump(counts, flat), attempt)
            yield from _pieces([(number, 0, 0, len(flat), name.encode(), [])]).to_batches()

    with _shuffles_removed(spark):
        blocks = stored_at(texts.mapInArrow(cut, PIECE), made[1])
        total = blocks.agg(F.sum("size")).first()[0] or 0
        n_shards = shards or max(-(-total // SHARD_WORDS), asked_bytes // SHARD_BYTES, min(2 * shuffle_partitions(spark), total // FEW_WORDS), 1)
        # small blocks are taken together
        taken = max(1, 4 * total // block_words)
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(taken)))

        def send(table: pa.Table) -> pa.Table:
            release()
            rows = _rows(table)
            counts, flat = (np.concatenate(x) for x in zip(*(_load(_read(name.decode())) for name in sorted(r[4] for r in rows if r[1] == 0)), strict=True))
            answers = {n: _together([r for r in rows if r[1] == n], 2) for n in {r[1] for r in rows} - {0}}
            level, keys, cols = _climb(counts, flat, order, answers)
            return _pieces(_to_shards(rows[0][0], level, keys, cols, n_shards))

        root = scratch_path(spark, "kn-model")
        make_folder(root)
        source, present, found = blocks, [], {}
        kinds, first = 0, (0, 0.0)
        for n in range(order, 0, -1):
            # the rows are small, the blocks are not: partitions by number, which are not merged by the size of rows
            sent = source.repartition(min(taken, MOST_TASKS), "block").groupBy("block").applyInArrow(send, PIECE)
            made.append(scratch_path(spark, f"kn-level{n}"))
            level = stored_at(sent.groupBy("shard").applyInArrow(lambda t: _add_up(t, root), PIECE), made[-1])
            # six numbers a shard
            seen = level.filter(F.col("block") == MODEL).select("shard", "keys").collect()
            n1, n2, n3, n4, kinds, words = np.sum([np.zeros(6, dtype=np.int64), *(np.frombuffer(r[1], "<i8") for r in seen)], axis=0).tolist()
            present += [(n, r[0]) for r in seen]
            d = found[n] = discounts(n1, n2, n3, n4)
            first = (words, n1 * d[0] + n2 * d[1] + (kinds - n1 - n2) * d[2])
            source = source.unionAll(level.filter(F.col("block") != MODEL))
    # the model is whole in its own files
    for path in made:
        remove_folder(path)
    return Model(order, root, n_shards, present, found, first, kinds + 1)


def _less(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts without their discounts; 0 stays 0."""
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


def train_tables(texts: DataFrame, order: int = ORDER, **settings) -> tuple[DataFrame, DataFrame]:
    """From (text): alphas (n, key, alpha) and gammas (n, ctx, gamma) of the interpolated model, row by row.

    p(w | ctx) = alpha(ctx w) + gamma(ctx) * p(w | shorter ctx), at the lowest order + gamma / vocabulary.  ``alpha`` is
    the discounted count alone; ``total`` of the context in the gammas divides it.
    """
    model = train_model(texts, order, **settings)
    d, root, spark = model.discounts, model.root, texts.sparkSession

    def counts(batches):
        for batch in batches:
            for level, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, (c, *_) = _read_shard(root, level, shard)
                yield pa.RecordBatch.from_arrays([pa.array(np.full((c > 0).sum(), level, dtype=np.int32)), _signed(keys[c > 0]), pa.array(_less(c, d[level])[c > 0])], ["n", "key", "alpha"])

    def contexts_of(batches):
        for batch in batches:
            for level, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if level < order:
                    keys, (_, *n, total) = _read_shard(root, level, shard)
                    on = total > 0
                    mass = sum(x * y for x, y in zip(n, d[level + 1], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), level + 1, dtype=np.int32)), _signed(keys[on]), pa.array(mass[on] / total[on]), pa.array(total[on])], ["n", "ctx", "gamma", "total"])

    words, mass = model.first
    top = spark.createDataFrame([(1, 0, mass / words, words)] if words else [], "n int, ctx long, gamma double, total long")
    shards = spark.createDataFrame(sorted(model.present), "level int, shard int")
    return shards.mapInArrow(counts, "n int, key long, alpha double"), shards.mapInArrow(contexts_of, "n int, ctx long, gamma double, total long").unionAll(top)


class Tables:
    """The finished tables of a small model in one place, as sorted keys, cut into shards by the keys' top bits."""

    def __init__(self, order: int, alphas: dict, gammas: dict, totals: dict):
        self.order, self.alphas, self.gammas, self.totals = order, alphas, gammas, totals
        self.vocabulary = sum(len(k) for k, _ in alphas[1]) + 1

    @classmethod
    def collect(cls, order: int, alphas: DataFrame, gammas: DataFrame, shards: int = SHARDS) -> Tables:
        def load(df: DataFrame, key: str, value: str) -> dict:
            t = df.select("n", key, F.col(value).cast("double")).toArrow()
            n, k, v = (t.column(i).to_numpy() for i in range(3))
            out = {}
            for i in range(1, order + 1):
                keys, values = k[n == i].view(np.uint64), v[n == i]
                by = np.argsort(keys, kind="stable")
                keys, values = keys[by], values[by]
                cuts = np.searchsorted(keys >> np.uint64(60), np.arange(1, shards, dtype=np.uint64))
                out[i] = list(zip(np.split(keys, cuts), np.split(values, cuts), strict=True))
            return out

        if shards != 16:
            raise ValueError("shards are the 16 values of the keys' four top bits")
        tables = cls(order, load(alphas, "key", "alpha"), load(gammas, "ctx", "gamma"), load(gammas, "ctx", "total"))
        pa.default_memory_pool().release_unused()  # the driver keeps nothing of the transfer
        return tables

    @staticmethod
    def join(shards: list, keys: np.ndarray, default: float) -> np.ndarray:
        """Values of the keys, shard by shard; ``default`` where a key is not in the table."""
        out = np.full(len(keys), default)
        by = np.argsort(keys)
        ordered = keys[by]
        cuts = np.searchsorted(ordered >> np.uint64(60), np.arange(1, len(shards), dtype=np.uint64))
        for (known, values), own, where in zip(shards, np.split(ordered, cuts), np.split(by, cuts), strict=True):
            if len(known) and len(own):
                k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[k] == own
                out[where[hit]] = values[k[hit]]
        return out

    def log_probs(self, texts: list[str | None], hasher: WordHash | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words, sum of natural log probabilities) per text; words are hashed here, ``hasher`` is not needed."""
        counts, keys, ctx = contexts(texts, self.order)
        p = np.full(int(counts.sum()), 1.0 / self.vocabulary)
        for n in range(1, self.order + 1):
            # n-grams repeat: each distinct key is joined once
            k, back = np.unique(keys[n], return_inverse=True)
            c, cback = np.unique(ctx[n - 1], return_inverse=True)
            p = self.join(self.alphas[n], k, 0.0)[back] / self.join(self.totals[n], c, 1.0)[cback] + self.join(self.gammas[n], c, 1.0)[cback] * p
        sums = np.zeros(len(counts))
        np.add.at(sums, np.repeat(np.arange(len(counts)), counts), np.log(p))
        return counts, sums


def trusted_labels(labels: DataFrame, id_col: str, hold_out: int = 5) -> DataFrame:
    """(id, fold): rows labelled good and never bad; fold 0 is kept out of training."""
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % hold_out).cast("int")
    return (labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("q")).filter("id is not null and q is not null")
            .groupBy("id").agg(F.min("q").alias("q")).filter("q = 1").select("id", fold.alias("fold")))


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the whole texts of all trusted rows outside fold 0; equal texts count once."""
    size = estimated_size_bytes(docs) or 0  # a frame without statistics has an absurd one
    chosen = broadcast_if_few(trusted_labels(labels, id_col).filter("fold <> 0").select("id"))
    return train_model(pick(docs, id_col, text_col).join(chosen, "id", "left_semi").select("text").distinct(), order, asked_bytes=size if size < 1 << 50 else 0)


# --------------------------------------------------------------------- scoring ---
def _answer(table: pa.Table, root: str, present: frozenset) -> pa.Table:
    """A shard: the model's counts of the n-grams that blocks ask for; 0 for unknown ones, no columns where the shard has none of the level."""
    release()
    out, level_of, found, cols = [], None, np.zeros(0, dtype=np.uint64), []
    for block, level, shard, size, keys, asks in sorted(_rows(table), key=lambda r: r[1]):
        if level == 0:
            out.append((block, level, shard, size, keys, asks))
            continue
        if (level, shard) not in present:
            out.append((block, level, shard, size, b"", []))
            continue
        if level != level_of:
            level_of, (found, cols) = level, _read_shard(root, level, shard)
        asked = _unpack_sorted(keys, size)
        at = np.minimum(np.searchsorted(found, asked), len(found) - 1)
        hit = found[at] == asked
        out.append((block, level, shard, size, b"", [_pack_counts(np.where(hit, c[at], 0)) for c in cols]))
    return _pieces(out)


def _asked(counts: np.ndarray, where: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the places of words and those before a word, where each word is among them): what n-grams below ``order`` are asked for."""
    asked = np.zeros(len(where) + (order - 1) * len(counts), dtype=bool)
    asked[where] = True
    asked[where - 1] = True
    return np.flatnonzero(asked), (np.cumsum(asked) - 1)[where]


def _log_probs(counts: np.ndarray, flat: np.ndarray, order: int, discounts: dict, first: tuple[int, float], vocabulary: int, answers: dict) -> np.ndarray:
    """Sums of log probabilities per text; ``answers[n]`` gives the columns of the block's distinct keys of level n."""
    grams, where = _grams(counts, flat, order)
    places, at = _asked(counts, where, order)
    p = np.full(len(flat), 1.0 / vocabulary)
    words, mass = first
    total, gamma = float(max(words, 1)), float(np.float32(mass / words)) if words else 1.0
    for n in range(1, order + 1):
        asked, _, back = _distinct_back(grams[n][where if n == order else places])
        cols = answers[n]
        if len(cols[0]) != len(asked):
            raise ValueError("the answers are not those of this block")
        # in single precision, as tables would hold them
        p = (_less(cols[0], discounts[n])[back if n == order else back[at]] / total).astype(np.float32).astype(float) + gamma * p
        if n < order:
            t = np.maximum(cols[4], 1).astype(float)
            m = np.where(cols[4] > 0, sum(x * y for x, y in zip(cols[1:4], discounts[n + 1], strict=True)), 1.0)
            # the place before a word is the one before it among the asked
            before = back[at - 1]
            total, gamma = t[before], (m / t).astype(np.float32).astype(float)[before]
    sums = np.zeros(len(counts))
    np.add.at(sums, np.repeat(np.arange(len(counts)), counts), np.log(p))
    return sums


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 lots: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, lang, text_hash, n_words, log_prob) of every whole text, stored."""
    spark = docs.sparkSession
    small_batches(spark)
    order, shards, root, present, discounts, first, vocabulary = model.order, model.shards, model.root, model.present, model.discounts, model.first, model.vocabulary
    src = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    lots = lots or max(1, min(LOTS, (estimated_size_bytes(src) or LOTS * LOT_BYTES) // LOT_BYTES))
    widths = {n: 1 if n == order else 5 for n in range(1, order + 1)}

    def ask(batches):
        for number, rows, counts, flat in _blocks(batches, block_words):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            # the block's words pass by a shard on their way to its answers
            yield from _pieces([(number, 0, number % shards, len(flat), _dump(counts, flat), [sink.getvalue().to_pybytes()])]).to_batches()
            grams, where = _grams(counts, flat, order)
            places, _ = _asked(counts, where, order)
            for n in range(1, order + 1):
                yield from _pieces(_to_shards(number, n, _distinct(grams[n][where if n == order else places]), [], shards)).to_batches()

    def add(table: pa.Table) -> pa.Table:
        release()
        rows = _rows(table)
        own = next(r for r in rows if r[1] == 0)
        counts, flat = _load(own[4])
        answers = {}
        for n, width in widths.items():
            answers[n] = _together([r if r[5] else (*r[:5], [_pack_counts(np.zeros(r[3], dtype=np.int64))] * width) for r in rows if r[1] == n], width)
        sums = _log_probs(counts, flat, order, discounts, first, vocabulary, answers)
        t = pa.ipc.open_stream(own[5][0]).read_all()
        return t.append_column("n_words", pa.array(counts, pa.int64())).append_column("log_prob", pa.array(sums, pa.float64()))

    kind = src.schema["id"].dataType.simpleString()
    out = f"id {kind}, lang string, text_hash long, n_words long, log_prob double"
    parts = None
    with _shuffles_removed(spark):
        for lot in range(lots):
            few = src.filter(F.pmod(F.xxhash64("id", "text_hash"), F.lit(lots)) == lot)
            answered = few.mapInArrow(ask, PIECE).groupBy("shard").applyInArrow(lambda t: _answer(t, root, present), PIECE)
            part = stored(answered.groupBy("block").applyInArrow(add, out), "kn-scores")
            parts = part if parts is None else parts.unionAll(part)
    return parts


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id") -> dict:
    """Language -> (mean, limit) of the mean negative log probability over all trusted rows outside the training
    fold; the key ``ALL`` holds those over all languages.  Only scores meet the labels, no texts; one row per
    language reaches the driver."""
    scored = scored.filter("n_words > 0").join(trusted_labels(labels, id_col), "id").select("lang", "fold", "n_words", "log_prob")
    means = scored.groupBy("lang", (F.col("fold") == 0).alias("out")).agg(F.sum("log_prob").alias("s"), F.sum("n_words").alias("n")).collect()
    if not means:
        return {}
    by = {(r[0], r[1]): r for r in means}
    # a language without rows outside the fold uses its rows inside
    used = {lang: by.get((lang, True)) or by[(lang, False)] for lang in {r[0] for r in means}}
    own = {lang: -r[2] / r[3] for lang, r in used.items()}
    average = -sum(r[2] for r in used.values()) / sum(r[3] for r in used.values())
    mean, wanted = F.lit(average), F.lit(False)
    for lang, m in own.items():
        same = F.col("lang").eqNullSafe(F.lit(lang))
        mean = F.when(same, F.lit(m)).otherwise(mean)
        wanted = wanted | (same & ((F.col("fold") == 0) if used[lang][1] else F.lit(True)))
    # how far a row's drawn-in rate lies over its language's mean
    excess = (-F.col("log_prob") - F.col("n_words") * mean) / (F.col("n_words") + PRIOR_WORDS)
    found = (scored.filter(wanted).select(F.coalesce("lang", F.lit("\0")).alias("l"), excess.alias("x")).rollup("l")
             .agg(F.percentile_approx("x", quantile, 10_000).alias("q"), F.count("*").alias("n")).collect())
    every = next(q for lang, q, _ in found if lang is None)
    out: dict = {ALL: (average, average + every)}
    for lang, q, n in found:
        if lang is not None:
            name = None if lang == "\0" else lang
            out[name] = (own[name], own[name] + (n * q + PRIOR_ROWS * every) / (n + PRIOR_ROWS))
    return out


class Classifier:
    """The model and the limits."""

    def __init__(self, model: Model | None, limits: dict):
        self.model, self.limits = model, limits

    def rate(self, lang: str | None, n: int, log_prob: float) -> tuple[float, float] | None:
        """(shrunk mean negative log probability, limit), or none for a text that is not judged."""
        mean_limit = self.limits.get(lang) or self.limits.get(ALL)
        if not n or mean_limit is None:
            return None
        mean, limit = mean_limit
        return (-log_prob + PRIOR_WORDS * mean) / (n + PRIOR_WORDS), limit


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Classifier, DataFrame]:
    """The classifier and the scores of all documents, written once, from which its limits were taken."""
    model = train(docs, labels, order, id_col, text_col)
    scored = perplexities(docs, model, id_col, text_col, lang_col)
    return Classifier(model, thresholds(scored, labels, quantile, id_col)), scored


def _rate_and_limit(model: Classifier, lang: Column, n_words: Column, log_prob: Column) -> tuple[Column, Column]:
    mean = limit = F.lit(None).cast("double")
    if model.limits:
        mean, limit = (F.lit(x) for x in model.limits[ALL])
        for name, (m, q) in model.limits.items():
            if name != ALL:
                same = lang.eqNullSafe(F.lit(name))
                mean, limit = F.when(same, F.lit(m)).otherwise(mean), F.when(same, F.lit(q)).otherwise(limit)
    return F.when(n_words > 0, (-log_prob + PRIOR_WORDS * mean) / (n_words + PRIOR_WORDS)), F.when(n_words > 0, limit)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """(id, lang, n_words, perplexity, rate, threshold, keep) of every whole text."""
    model, scored = fit(docs, labels, id_col=id_col, **settings)
    rate, limit = _rate_and_limit(model, F.col("lang"), F.col("n_words"), F.col("log_prob"))
    return scored.select(F.col("id").alias(id_col), "lang", "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))).alias("perplexity"),
                         rate.alias("rate"), limit.alias("threshold"), F.coalesce(rate <= limit, F.lit(True)).alias("keep"))


def _kept(docs: DataFrame, scored: DataFrame, model: Classifier, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``docs`` without the rows whose rate is over their language's limit; rows of one id may have different texts."""
    rate, limit = _rate_and_limit(model, F.col("lang"), F.col("n_words"), F.col("log_prob"))
    gone = scored.filter(rate > limit).select("id", "lang", "text_hash").distinct()
    same = (docs[id_col].eqNullSafe(gone["id"]) & docs[lang_col].cast("string").eqNullSafe(gone["lang"])
            & (F.xxhash64(docs[text_col].cast("string")) == gone["text_hash"]))
    return docs.join(broadcast_if_few(gone), same, "left_anti")


def good_rows(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER,
              id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with all columns, without the rows whose rate is over their language's limit; every text is scored once."""
    model, scored = fit(docs, labels, quantile, order, id_col, text_col, lang_col)
    return _kept(docs, scored, model, id_col, text_col, lang_col)


def without_low_quality(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with all columns, without the rows whose rate is over their language's limit."""
    return _kept(docs, perplexities(docs, model.model, id_col, text_col, lang_col), model, id_col, text_col, lang_col)
