"""Cross-tokenizer alignment: which tokens of two public vocabularies stand for the same bytes.

A text is encoded by a byte-level vocabulary A (with a space in front) and by a
SentencePiece model B (which adds that space).  The byte offsets where tokens of both
end cut the text into groups; every A token of a group is linked to every B token of
it.  For each id pair the number of documents that hold it linked is counted over the
whole corpus, and each document gets those counts of its own links back.

Counting: the first pass aligns the documents and writes each task's distinct pairs
with its numbers of documents.  The distinct pairs are dealt to ``SHARDS`` shards by
hash (ids are bounded, so a shard is: 6.3 million pairs at most); for each shard a
minimal perfect hash is built: levels of bit arrays, a pair that meets no other at its
bit stays there, the others go on to the next level, and the rank of the bit is the
pair's number.  Each task's counts become a dense vector per shard, indexed by that
number, and the vectors are summed in a tree of ``FAN`` at a time.  The keys are kept
in the order of the numbers and checked at every lookup.

The second pass aligns the documents again and looks the counts up.  The table is
broadcast in lots of at most about ``LOT_PAIRS`` pairs; a larger one takes more passes
whose sums are added per row.

Texts are aligned piece by piece: a piece ends where both encoders are known to cut,
whatever stands around it (before a space that follows other characters, and between
Latin letters and ASCII characters that are none).  Pieces are kept in a cache of
bounded bytes, which changes the time only.

Defined results: a null or empty text, and one whose tokens' bytes differ from the
text's (B reads U+2581 as a space), has no tokens: zeros and an empty digest; repeated
rows are each a document; null ids are ids; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.bpe import byte_alphabet
from paytrail.llm.common import Shared, held, no_cycles, pick, small_batches, stored

SHARDS, FAN = 256, 32
LOT_PAIRS = 4_000_000
# distinct pairs that a task holds before it writes them
TASK_PAIRS = 2_000_000
# pieces and characters that a task keeps between batches
CACHE_PIECES, CACHE_CHARS = 300_000, 8_000_000
# links of one group that are written out one by one; a larger group is counted by its distinct ids
GROUP_LINKS = 200_000
JOINED = 500
_KEYS = 1 << 31  # more than there are pairs of ids; checked where the encoders are read
_LETTER, _NEXT = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-@\[-`{-~\n\t\r"
_SPLIT = re.compile(rf" ?[{_LETTER}]+(?![^ {_NEXT}])|.+?(?:(?<=[^\s᠎])(?= )|(?<=[{_LETTER}])(?=[{_NEXT}])|\Z)", re.S).findall


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint64), 0) % np.uint64(SHARDS)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: level by level a bit for every key that is alone at its place."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        # numbers before each byte of all levels
        counts = [np.bitwise_count(x).astype(np.int64) for x in levels]
        self.size = int(sum(c.sum() for c in counts))
        self.before, done = [], 0
        for c in counts:
            ends = done + np.cumsum(c)
            self.before.append(ends - c)
            done = int(ends[-1])

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (_mix(keys, level + 1) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.view(np.uint64)
        while len(left):
            bits = 8 * math.ceil(2 * len(left) / 8)
            at = cls._place(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; any number or -1 for a key that was not hashed."""
        out, where, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), keys.view(np.uint64)
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = self._place(left, level, 8 * len(bits))
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            raw = bits[byte]
            hit = (raw >> bit) & np.uint8(1) == 1
            below = np.bitwise_count(raw & ((np.uint8(1) << bit) - np.uint8(1)))
            out[where[hit]] = (before[byte] + below)[hit]
            where, left = where[~hit], left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in self.levels]

    @classmethod
    def from_bytes(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(x, dtype=np.uint8) for x in levels])


class Encoders:
    """Both tokenizers as plain values that can be broadcast."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path_a, encoding="utf-8") as f:
            self.a = f.read()
        spec = json.loads(self.a)
        front = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or front.get("type") != "ByteLevel" or front.get("add_prefix_space") or not front.get("use_regex"):
            raise ValueError("A is not a byte-level BPE vocabulary without a normaliser")
        raw = {c: b for b, c in enumerate(byte_alphabet())}
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: None for t in spec.get("added_tokens", [])}
        self.bytes_a = [b"" if (s := names.get(i)) is None else bytes(raw[c] for c in s) for i in range(max(names) + 1)]
        model = pb.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("B is not a BPE model with the identity as its normaliser and a space in front")
        plain = [p.piece for p in model.pieces if p.type == 1]
        if any(re.search("[^▁]▁", p) or re.search(rf"[{_LETTER}][^{_LETTER}]", p) for p in plain):
            raise ValueError("a piece of B spans a place where texts are cut")
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() if p.type == 1 else b"" for p in model.pieces]
        if len(self.bytes_a) * len(self.bytes_b) >= _KEYS:
            raise ValueError("too many pairs of ids")
        rules.add_dummy_prefix = False  # the space in front is part of the pieces here
        self.b = model.SerializeToString()


class Aligner:
    """Encoders in a Python worker, and what a pass keeps of every piece, by the piece's number."""

    def __init__(self, enc: Encoders):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.lib_a = Tokenizer.from_str(enc.a)
        self.lib_a.encode_special_tokens = True
        self.lib_b = sentencepiece.SentencePieceProcessor(model_proto=enc.b)
        self.bytes_a, self.bytes_b = enc.bytes_a, enc.bytes_b
        self.len_a, self.len_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (enc.bytes_a, enc.bytes_b))
        self.many_b = len(enc.bytes_b)
        # a token's number with what follows it in the text of the groups
        a, b = ([str(i) for i in range(len(x))] for x in (enc.bytes_a, enc.bytes_b))
        self.written = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b] + b
        self.cleared()

    def cleared(self) -> None:
        self.cache: dict[str, int] = {}  # piece -> its number
        self.chars = 0
        self.bad = np.zeros(0, dtype=bool)
        # first pass: the pieces' distinct link keys, piece by piece
        self.keys_of, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # second pass: six sums and the text of the groups of each piece
        self.sums_of, self.names = np.zeros((0, 6), np.int64), []

    def pieces(self, text: str | None) -> list[str]:
        return _SPLIT(" " + text) if text else []

    def _ids_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece); pieces that begin with a space and end with none are encoded behind one another."""
        joins = [p[0] == " " and not p[-1].isspace() and p[-1] != "᠎" for p in pieces]
        row = [i for i, j in enumerate(joins) if j]
        alone = [i for i, j in enumerate(joins) if not j]
        lots = [row[i : i + JOINED] for i in range(0, len(row), JOINED)] + [[i] for i in alone]
        got = [e.ids for e in self.lib_a.encode_batch_fast(["".join([pieces[i] for i in lot]) for lot in lots], add_special_tokens=False)]
        order = np.array(list(chain.from_iterable(lots)), dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(got), dtype=np.int64)
        ends = np.cumsum(self.len_a[flat])
        sizes = np.cumsum([len(pieces[i].encode("utf-8")) for i in order])
        last = np.searchsorted(ends, sizes)
        if (ends[last] != sizes).any():
            raise ValueError("the encoder joined two pieces")
        counts = np.diff(np.r_[0, last + 1])
        # back into the order of the pieces
        owner = np.repeat(order, counts)
        per = np.zeros(len(pieces), dtype=np.int64)
        per[order] = counts
        return flat[np.argsort(owner, kind="stable")], per

    def align(self, pieces: list[str]):
        """Flat ids of both sides with their group, the piece of every group, and the pieces whose bytes differ."""
        a, per_a = self._ids_a(pieces)
        got = self.lib_b.encode(pieces, num_threads=1)
        b, per_b = np.fromiter(chain.from_iterable(got), dtype=np.int64), np.fromiter(map(len, got), np.int64, len(got))
        bad = np.zeros(len(pieces), dtype=bool)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != b"".join(map(self.bytes_b.__getitem__, b.tolist())):
            at_a, at_b = np.cumsum(np.r_[0, per_a]), np.cumsum(np.r_[0, per_b])
            for i in range(len(pieces)):
                bad[i] = b"".join(self.bytes_a[x] for x in a[at_a[i] : at_a[i + 1]]) != b"".join(self.bytes_b[x] for x in b[at_b[i] : at_b[i + 1]])
            a, b = a[np.repeat(~bad, per_a)], b[np.repeat(~bad, per_b)]
            per_a, per_b = np.where(bad, 0, per_a), np.where(bad, 0, per_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        # a piece's last token ends a group
        piece_of = np.zeros(len(ends), dtype=np.int64)
        piece_of[group_a] = np.repeat(np.arange(len(pieces)), per_a)
        return a, group_a, b, group_b, piece_of, bad

    def links(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int):
        """(keys, occurrences, group) of the links; large groups by distinct ids."""
        na, nb = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        large = np.flatnonzero(na * nb > GROUP_LINKS)
        first_b = np.cumsum(nb) - nb
        times = nb[group_a]
        times[np.isin(group_a, large)] = 0
        total = int(times.sum())
        within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        keys = np.repeat(a, times) * self.many_b + b[np.repeat(first_b[group_a], times) + within]
        parts = [(keys, np.ones(total, dtype=np.int64), np.repeat(group_a, times))]
        for g in large.tolist():
            xs, cx = np.unique(a[group_a == g], return_counts=True)
            ys, cy = np.unique(b[group_b == g], return_counts=True)
            parts.append(((xs[:, None] * self.many_b + ys[None, :]).ravel(), (cx[:, None] * cy[None, :]).ravel(), np.full(len(xs) * len(ys), g)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)), na, nb

    def numbered(self, texts: list[str | None], learn) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces of all texts, pieces per text); ``learn`` is given the new pieces."""
        split = [self.pieces(t) for t in texts]
        missing = list(set(chain.from_iterable(split)).difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cleared()
            missing = list(set(chain.from_iterable(split)))
        self.chars += sum(map(len, missing))
        if missing:
            self.cache.update(zip(missing, range(len(self.bad), len(self.bad) + len(missing)), strict=True))
            learn(missing)
        flat = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        return flat, np.fromiter(map(len, split), np.int64, len(split))

    def trim(self) -> None:
        if self.chars > CACHE_CHARS:
            self.cleared()

    def learn_keys(self, pieces: list[str]) -> None:
        a, group_a, b, group_b, piece_of, bad = self.align(pieces)
        (keys, _, group), _, _ = self.links(a, group_a, b, group_b, len(piece_of))
        both = np.unique(piece_of[group] * _KEYS + keys)
        self.keys_of = np.r_[self.keys_of, both % _KEYS]
        self.many = np.r_[self.many, np.bincount(both // _KEYS, minlength=len(pieces))]
        self.bad = np.r_[self.bad, bad]

    def keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct link keys of some texts and in how many of the texts each is."""
        flat, per = self.numbered(texts, self.learn_keys)
        text = np.repeat(np.arange(len(texts)), per)
        wrong = np.zeros(len(texts), dtype=bool)
        wrong[text[self.bad[flat]]] = True
        known = len(self.bad)
        pairs = np.unique((text * known + flat)[~wrong[text]])
        text, flat = pairs // max(known, 1), pairs % max(known, 1)
        first, many = np.cumsum(self.many) - self.many, self.many[flat]
        total = int(many.sum())
        at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[flat], many)
        both = np.unique(np.repeat(text, many) * _KEYS + self.keys_of[at])
        self.trim()
        return np.unique(both % _KEYS, return_counts=True)

    def learn_sums(self, pieces: list[str], table: Table) -> None:
        a, group_a, b, group_b, piece_of, bad = self.align(pieces)
        (keys, often, group), na, nb = self.links(a, group_a, b, group_b, len(piece_of))
        counts, best = table.counts(keys)
        many = len(pieces)
        sums = np.zeros((many, 6), dtype=np.int64)
        for column, where, x in ((0, piece_of, na), (1, piece_of, nb), (2, piece_of, 1), (3, piece_of, na * nb), (4, piece_of[group], often * best), (5, piece_of[group], often * counts)):
            np.add.at(sums[:, column], where, x)
        # the text of the groups: every token's number with its mark, A before B in each group
        size_a, size_b = len(self.bytes_a), self.many_b
        last_a, last_b = (np.r_[g[1:] != g[:-1], True][: len(g)] for g in (group_a, group_b))
        ends = np.r_[piece_of[1:] != piece_of[:-1], True][: len(piece_of)][group_b] & last_b
        code = np.r_[a + size_a * last_a, 2 * size_a + b + size_b * last_b + size_b * ends]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        tokens = list(map(self.written.__getitem__, code[order].tolist()))
        cuts = np.cumsum(sums[:, 0] + sums[:, 1]).tolist()
        self.names += ["".join(tokens[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]
        self.sums_of = np.r_[self.sums_of, sums]
        self.bad = np.r_[self.bad, bad]

    def sums(self, texts: list[str | None], table: Table) -> tuple[np.ndarray, list[str]]:
        """Per text the six sums of its pieces and the digest of its groups; texts without tokens have none."""
        flat, per = self.numbered(texts, lambda new: self.learn_sums(new, table))
        out, digests, name, low = np.zeros((len(texts), 6), dtype=np.int64), [], self.names.__getitem__, 0
        for i, n in enumerate(per.tolist()):
            own = flat[low : low + n]
            low += n
            if not n or self.bad[own].any():
                digests.append("")
                continue
            out[i] = self.sums_of[own].sum(axis=0)
            digests.append(hashlib.sha256(";".join(map(name, own.tolist())).encode()).hexdigest())
        self.trim()
        return out, digests


class Table:
    """Some shards of the counts, and each A id's highest count of all shards."""

    def __init__(self, shards: dict[int, tuple], best: np.ndarray, many_b: int):
        self.shards, self.best, self.many_b = shards, best, many_b

    def open(self) -> Table:
        return Table({s: (PerfectHash.from_bytes(h), np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for s, (h, k, c) in self.shards.items()}, self.best, self.many_b)

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys, 0 where their shard is not here, and whether that is the A id's highest."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        shards = shard_of(distinct)
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(1, SHARDS))
        for s, where in enumerate(np.split(order, cuts)):
            if len(where) and s in self.shards:
                hash_, known, counts = self.shards[s]
                at = hash_.numbers(distinct[where])
                if (at < 0).any() or (known[at] != distinct[where]).any():
                    raise ValueError("a link was not counted in the first pass: the documents must read the same twice")
                out[where] = counts[at]
        best = (out > 0) & (out == self.best[distinct // self.many_b])
        return out[back], best[back]


def _partial(docs: DataFrame, shared: Shared) -> DataFrame:
    """(shard, part, keys, counts): each task's distinct pairs and in how many of its documents they are linked."""
    def run(batches):
        no_cycles()
        aligner, keys, counts, waiting, lot = shared.get(), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        task = TaskContext.get().partitionId()

        def merged():
            every = np.concatenate([keys, *(k for k, _ in waiting)])
            distinct, back = np.unique(every, return_inverse=True)
            return distinct, np.bincount(back, weights=np.concatenate([counts, *(c for _, c in waiting)]), minlength=len(distinct)).astype(np.int64)

        def written():
            shards = shard_of(keys)
            order = np.argsort(shards, kind="stable")
            cuts = np.searchsorted(shards[order], np.arange(1, SHARDS))
            rows = [(s, k, c) for s, (k, c) in enumerate(zip(np.split(keys[order], cuts), np.split(counts[order], cuts), strict=True)) if len(k)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([task * 4096 + lot] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                ["shard", "part", "keys", "counts"])

        for batch in batches:
            waiting.append(aligner.keys(batch.column(1).to_pylist()))
            if sum(len(k) for k, _ in waiting) > TASK_PAIRS:
                (keys, counts), waiting = merged(), []
                if len(keys) > TASK_PAIRS:
                    yield written()
                    keys, counts, lot = keys[:0], counts[:0], lot + 1
        keys, counts = merged()
        if len(keys):
            yield written()

    return stored(docs.mapInArrow(run, "shard int, part long, keys array<long>, counts array<long>"), "align-partial")


def _hashes(partial: DataFrame) -> DataFrame:
    """(shard, size, levels, keys): a minimal perfect hash of each shard's distinct pairs, the keys by their numbers."""
    def build(table):
        keys = table["key"].to_numpy()
        hash_ = PerfectHash.build(keys)
        by = np.empty(len(keys), dtype=np.int64)
        by[hash_.numbers(keys)] = keys
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([hash_.to_bytes()], pa.list_(pa.binary())), pa.array([by.tobytes()], pa.binary())], ["shard", "size", "levels", "keys"])

    distinct = partial.select("shard", F.explode("keys").alias("key")).distinct()
    return stored(distinct.groupBy("shard").applyInArrow(build, "shard int, size long, levels array<binary>, keys binary"), "align-hashes")


def _counted(partial: DataFrame, hashes: DataFrame) -> DataFrame:
    """(shard, counts): the dense count vector of each shard, summed in a tree."""
    def dense(batches):
        for batch in batches:
            vectors = []
            for size, levels, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("size", "levels", "keys", "counts")), strict=True):
                vector = np.zeros(size, dtype=np.int64)
                vector[PerfectHash.from_bytes(levels).numbers(np.array(keys, dtype=np.int64))] = counts
                vectors.append(vector.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("part"), pa.array(vectors, pa.binary())], ["shard", "part", "vector"])

    def add(table):
        total = None
        for raw in table["vector"]:
            vector = np.frombuffer(raw.as_buffer(), dtype=np.int64)
            total = vector.copy() if total is None else total + vector
        return pa.table([table["shard"][:1].cast(pa.int32()), table["part"][:1], pa.array([total.tobytes()], pa.binary())], ["shard", "part", "vector"])

    many = partial.select("part").distinct().count()
    joined = partial.join(hashes.select("shard", "size", "levels"), "shard")
    vectors = joined.mapInArrow(dense, "shard int, part long, vector binary")
    # a node of the tree adds about FAN vectors of one shard
    while many > FAN:
        many = math.ceil(many / FAN)
        node = F.pmod(F.xxhash64("part"), F.lit(many)).alias("part")
        vectors = vectors.select("shard", node, "vector").groupBy("shard", "part").applyInArrow(add, "shard int, part long, vector binary")
    return vectors.groupBy("shard").applyInArrow(add, "shard int, part long, vector binary").select("shard", F.col("vector").alias("counts"))


def count_pairs(docs: DataFrame, shared: Shared) -> DataFrame:
    """(shard, size, levels, keys, counts): the stored table of all linked pairs and the documents that hold them."""
    partial = _partial(docs, shared)
    hashes = _hashes(partial)
    return stored(hashes.join(_counted(partial, hashes), "shard"), "align-table")


def _highest(table: DataFrame, many_a: int, many_b: int) -> np.ndarray:
    """The highest count of each A id; one row an id reaches the driver."""
    def run(batches):
        for batch in batches:
            best = np.zeros(many_a, dtype=np.int64)
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                np.maximum.at(best, np.frombuffer(k, np.int64) // many_b, np.frombuffer(c, np.int64))
            ids = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], ["a", "best"])

    rows = table.select("keys", "counts").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toArrow()
    out = np.zeros(many_a, dtype=np.int64)
    out[rows["a"].to_numpy()] = rows["best"].to_numpy()
    return out


SUMS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(src: DataFrame, key: str, encoders: Shared, shards: Shared) -> DataFrame:
    names = [f.split()[0] for f in SUMS.split(", ")]

    def run(batches):
        no_cycles()
        aligner, table = held(key, lambda: (Aligner(encoders.value.value), shards.value.value.open()))
        for batch in batches:
            sums, digests = aligner.sums(batch.column("text").to_pylist(), table)
            arrays = [*(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [batch.schema.names[0], *names])

    first = src.schema.fields[0]
    return src.mapInArrow(run, T.StructType([first, *T._parse_datatype_string(SUMS).fields]))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", lot_pairs: int = LOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text."""
    spark = docs.sparkSession
    src = pick(docs, id_col, text_col)
    small_batches(spark)
    encoders = Encoders(path_a, path_b)
    shared = Shared(spark, encoders, Aligner)
    many_a, many_b = len(encoders.bytes_a), len(encoders.bytes_b)
    table = count_pairs(src, shared)
    sizes = {r.shard: r.size for r in table.select("shard", "size").collect()}
    best = _highest(table, many_a, many_b)
    lots: list[list[int]] = [[]]
    for s, size in sorted(sizes.items()):
        if lots[-1] and sum(sizes[x] for x in lots[-1]) + size > lot_pairs:
            lots.append([])
        lots[-1].append(s)

    def lot_table(lot: list[int]) -> Shared:
        rows = table.filter(F.col("shard").isin(lot)).collect() if lot else []
        return Shared(spark, Table({r.shard: (list(map(bytes, r.levels)), bytes(r["keys"]), bytes(r.counts)) for r in rows}, best, many_b))

    if len(lots) == 1:
        return _looked_up(src, uuid.uuid4().hex, shared, lot_table(lots[0])).withColumnRenamed("id", id_col)
    # one pass a lot over numbered rows; a row's sums are added, the rest is the same in every pass
    numbered = stored(src.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "align-rows")
    sums = None
    for lot in lots:
        one = _looked_up(numbered.select("row", "text"), uuid.uuid4().hex, shared, lot_table(lot))
        sums = one if sums is None else sums.unionAll(one)
    same = [F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    total = sums.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups_sha256").alias("groups_sha256"))
    return numbered.select("row", "id").join(total, "row").drop("row").withColumnRenamed("id", id_col)
