"""Stupid-backoff language-model scores, computed relationally.

S(w | u v) = c(u v w) / c(u v) where the corpus has u v w at least ``min_count``
times; otherwise ALPHA * S(w | v), down to c(w) / N.  All counts are over the whole
corpus, the scored documents included, so ``min_count`` = 2 keeps an n-gram that
only its own position has from scoring itself.

The join runs on 64-bit n-gram hashes in three shuffles of packed rows:

1. documents are read in blocks of at most ``BLOCK_WORDS`` words; a block explodes
   its n-grams of every order, counts equal ones at once (the combine step) and
   sends each hash shard its sorted distinct hashes with counts, one row a shard;
2. a shard adds up the counts of its n-grams over all blocks, which is the count
   table's partition, and sends every block the totals of the hashes it asked for;
3. a block meets its own words again and its totals, looks up each position's
   n-grams and sums the log scores per document.

A frequent n-gram is one hash per block, so no shard gets more of it than there
are blocks; shards are even, as hashes are.  Blocks are bounded by ``BLOCK_WORDS``,
and there is a shard for every ``SHARD_WORDS`` words of the corpus at least, so one
shard's n-grams do not grow with the corpus.

Words are the ASCII-lower-cased words of :func:`words_of`; n-grams do not cross
documents, and a document's first words have shorter contexts.

Defined results: a null or empty text, or one without words, has n_words 0,
log_score 0 and score null; repeated rows are each scored (and counted); a null id
is kept; ids are integers; an empty table gives an empty result; other columns are
not read.  ``docs`` must be a stored table: it is read twice, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrail.llm.common import pick, shuffle_partitions, small_batches, words_of

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 4_000_000
_M1, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Some documents: their ids, lengths and words as numbers of the block's vocabulary."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, vocabulary: list[bytes], words: np.ndarray):
        self.ids, self.lengths, self.vocabulary, self.words = ids, lengths, vocabulary, words

    def dump(self) -> bytes:
        """Compressed: ids, lengths, vocabulary (words hold no space), words by byte planes."""
        head = np.array([len(self.ids), len(self.words)], dtype="<i8").tobytes()
        ids = np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + np.array([x is None for x in self.ids], dtype=np.uint8).tobytes()
        planes = self.words.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + ids + self.lengths.astype("<i8").tobytes() + planes + b" ".join(self.vocabulary))

    @classmethod
    def load(cls, raw: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        docs, n = np.frombuffer(raw, "<i8", 2).tolist()
        at = 16
        ids, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
        null, at = np.frombuffer(raw, "u1", docs, at), at + docs
        lengths, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
        planes, at = np.frombuffer(raw, "u1", 4 * n, at), at + 4 * n
        words = np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()
        return cls([None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], lengths, raw[at:].split(b" ") if n else [], words)

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 1..order: (positions where n words of one document end, hash of those n words)."""
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], dtype=np.uint64)
        h = known[self.words] if len(self.words) else np.zeros(0, dtype=np.uint64)
        place = np.arange(len(h)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        out, key = [], np.zeros(0, dtype=np.uint64)
        for n in range(1, order + 1):
            at = np.flatnonzero(place >= n - 1)
            # the key of n words from that of the first n - 1 (which end one position earlier)
            before = np.full(len(h), np.uint64(0))
            if n > 1:
                before[out[-1][0]] = out[-1][1]
            key = ((before[at - 1] if n > 1 else np.uint64(0)) + _G) ^ h[at]
            key = (key ^ (key >> np.uint64(30))) * _M1
            key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append((at, key ^ (key >> np.uint64(31))))
        return out


def _blocks(batches, block_words: int):
    """(block number, block) of a task's rows; the number is the task's partition and a sequence."""
    part, seq = TaskContext.get().partitionId(), 0
    ids, lengths, words, vocab, n = [], [], [], {}, 0

    def close():
        nonlocal ids, lengths, words, vocab, n, seq
        flat = np.concatenate(words) if words else np.zeros(0, dtype=np.uint32)
        # frequent words first: small numbers compress well
        order = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names = list(vocab)
        out = (part << 20 | seq, Block(ids, np.array(lengths, dtype=np.int64), [names[i] for i in order], rank[flat] if len(flat) else flat))
        ids, lengths, words, vocab, n, seq = [], [], [], {}, 0, seq + 1
        return out

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words_of(text)
            if ids and n + len(own) > block_words:
                yield close()
            get = vocab.setdefault
            ids.append(i)
            lengths.append(len(own))
            if own:
                words.append(np.array([get(w, len(vocab)) for w in own], dtype=np.uint32))
            n += len(own)
    if ids:
        yield close()


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64: first value and the differences in as few whole bytes as the largest needs."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + values[:1].tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    width, first = raw[0], np.frombuffer(raw, np.uint64, 1, 1)
    gaps = np.zeros((n - 1, 8), dtype=np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]), dtype=np.uint64)


def _pack_counts(values: np.ndarray) -> bytes:
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top <= np.iinfo(k).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype("<" + kind).tobytes())


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[2:]), "<" + raw[:2].decode()).astype(np.int64)


def _distinct(block: Block, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every order: (positions, index into the distinct hashes, distinct hashes, their counts)."""
    out = []
    for at, key in block.grams(order):
        values, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        out.append((at, back.ravel(), values, counts))
    return out


def _cuts(values: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted hashes pass from one shard to the next: shards are equal ranges of the hash space."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


SENT = "shard int, block long, n int, size int, hashes binary, counts binary"
BACK = "block long, kind int, shard int, body binary"


def scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text",
           shards: int | None = None, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, n_words, n_highest, log_score, score): n_highest counts the positions that no longer context could
    improve (those scored at the full order); score is the mean log score per word."""
    spark = docs.sparkSession
    small_batches(spark)
    src = pick(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))

    def count(batches):
        n = sum(len(words_of(t)) for batch in batches for t in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    total = src.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    n_shards = shards or max(2 * shuffle_partitions(spark), -(-total // shard_words))

    def send(batches):
        for number, block in _blocks(batches, block_words):
            for n, (_, _, values, counts) in enumerate(_distinct(block, order), 1):
                cuts = _cuts(values, n_shards)
                lots = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _, _ in lots], pa.int32()), pa.array([number] * len(lots), pa.int64()), pa.array([n] * len(lots), pa.int32()),
                    pa.array([b - a for _, a, b in lots], pa.int32()), pa.array([_pack_sorted(values[a:b]) for _, a, b in lots], pa.binary()),
                    pa.array([_pack_counts(counts[a:b]) for _, a, b in lots], pa.binary())], ["shard", "block", "n", "size", "hashes", "counts"])

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, lot in rows.groupby("n"):
            hashes = [_unpack_sorted(h, k) for h, k in zip(lot["hashes"], lot["size"], strict=True)]
            values, back = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.zeros(len(values), dtype=np.int64)
            np.add.at(totals, back.ravel(), np.concatenate([_unpack_counts(c) for c in lot["counts"]]))
            ends = np.cumsum(lot["size"].to_numpy())
            for number, a, b in zip(lot["block"], ends - lot["size"].to_numpy(), ends, strict=True):
                out.append((number, n, int(lot["shard"].iloc[0]), _pack_counts(totals[back.ravel()[a:b]])))
        return pd.DataFrame(out, columns=["block", "kind", "shard", "body"])

    def words(batches):
        for number, block in _blocks(batches, block_words):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([block.dump()], pa.binary())], ["block", "kind", "shard", "body"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block.load(rows.loc[rows["kind"] == 0, "body"].iloc[0])
        size = len(block.words)
        found = []
        for n, (at, back, values, _) in enumerate(_distinct(block, order), 1):
            lots = rows[rows["kind"] == n].sort_values("shard")
            totals = np.concatenate([_unpack_counts(x) for x in lots["body"]]) if len(lots) else np.zeros(0, dtype=np.int64)
            if len(totals) != len(values):
                raise ValueError("the documents changed between the two readings")
            c = np.zeros(size, dtype=np.int64)
            c[at] = totals[back]
            found.append(c)  # the corpus count of the n words that end at each position
        s = np.log(found[0] / total) if size else np.zeros(0)
        top = np.zeros(size, dtype=bool)
        for n in range(2, order + 1):
            here = found[n - 1]
            context = np.concatenate([[0], found[n - 2][:-1]])
            hit = here >= min_count
            possible = here > 0
            back_off = np.where(possible, s + math.log(alpha), s)
            s = np.where(hit, np.log(np.maximum(here, 1) / np.maximum(context, 1)), back_off)
            top = hit
        starts = np.cumsum(block.lengths) - block.lengths
        sums = np.array([s[a : a + n].sum() for a, n in zip(starts.tolist(), block.lengths.tolist(), strict=True)])
        tops = np.array([int(top[a : a + n].sum()) for a, n in zip(starts.tolist(), block.lengths.tolist(), strict=True)])
        score = [x / n if n else None for x, n in zip(sums.tolist(), block.lengths.tolist(), strict=True)]
        return pd.DataFrame({"id": pd.array(block.ids, dtype="Int64"), "n_words": block.lengths, "n_highest": tops, "log_score": sums, "score": score})

    totals = src.mapInArrow(send, SENT).groupBy("shard").applyInPandas(add_up, BACK)
    both = src.mapInArrow(words, BACK).unionAll(totals)
    return both.groupBy("block").applyInPandas(add, "id long, n_words long, n_highest long, log_score double, score double").withColumnRenamed("id", id_col)
