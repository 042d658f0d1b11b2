"""SentencePiece BPE encoding and decoding with a given public model (nothing is trained here).

Encoding works on flat numpy arrays: the symbols of many words lie behind one
another, and in every round each word finds the smallest rank among its adjacent
pairs (a segmented minimum), merges all its pairs of that rank at once, leftmost
first and without overlap, and the array is compacted.  A word without a pair of the
vocabulary leaves the array; the rounds end when none is left.

The library merges one pair at a time, best score first, leftmost among equals.  The
rounds give the same result: a merge at rank r can only disturb other pairs of rank
r through a new pair of rank r or better.  Where the vocabulary allows such a pair
(a "risky" rank), only the first of the pairs that lie within reach of each other is
merged in a round; reach is far more than the longest piece, which bounds what one
merge can set off.  Words are cut where no piece of the vocabulary spans (checked when
a model is loaded): before white space that follows other characters, and between
Latin letters and others.

Encoded words are kept in a cache of bounded bytes; it changes the time only.
Decoding joins the vocabulary's strings, byte pieces as UTF-8.

Defined results: a null text is an empty text (no ids, empty decoded text); repeated
rows and ties give one output row each; an empty table gives an empty table; other
columns of the input are not read.  A model of another kind (no plain BPE, a
normaliser other than the identity, pieces of the user) is refused.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paytrail.llm.common import Shared, no_cycles, pick, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# cached words and the longest that is kept: their product bounds the cache's bytes
CACHE_WORDS, LONG_WORD = 300_000, 64
_CODES = 0x110000
_NONE = np.iinfo(np.int32).max
_WIDE = 16  # a run of white space is cut after so many, as the model's widest white-space piece
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"


def read_model(path: str) -> dict:
    """What encoding needs of a model file, as plain values."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, trainer = model.normalizer_spec, model.trainer_spec
    if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("not a BPE model with byte fallback and white space in front")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError("the model's normaliser is not the identity with a space in front")
    return {"pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "types": [p.type for p in model.pieces], "unknown": trainer.unk_surface}


class Pieces:
    """A vocabulary with its merge table."""

    def __init__(self, model: dict):
        pieces, scores, types = model["pieces"], model["scores"], model["types"]
        if not set(types) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of the user or unused ones")
        self.size = len(pieces)
        vocab = {p: i for i, p in enumerate(pieces) if types[i] == NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocab):
            raise ValueError("a piece spans white space after other characters")
        if any(c not in vocab for p in vocab for c in p):
            raise ValueError("a character of a piece is no piece itself")
        self.bytes = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        # a character outside the vocabulary is its own symbol, which no merge knows
        self.symbol = np.arange(_CODES, dtype=np.int32) + self.size
        for p, i in vocab.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in vocab.values()}, reverse=True))}
        rank = [order.get(s, _NONE) for s in scores]
        rows = sorted((self._key(vocab[p[:k]], vocab[p[k:]]), i, vocab[p[:k]], vocab[p[k:]]) for p, i in vocab.items() for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab)
        self.keys = np.array([r[0] for r in rows] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.merged = np.array([r[1] for r in rows] + [-1], dtype=np.int32)
        self.rank = np.array([rank[r[1]] for r in rows] + [_NONE], dtype=np.int32)
        # ranks whose merge can make a pair of the same rank or a better one
        self.risky = np.zeros(len(order), dtype=bool)
        for _, i, a, b in rows:
            for part in (a, b):
                if rank[part] != _NONE and rank[i] <= rank[part]:
                    self.risky[rank[part]] = True
        self.reach = 4 * max(map(len, vocab))
        self.none = len(rows)
        apart = not any(re.search(f"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{SPACE}][{_LETTER}]", p) for p in vocab)
        word = f"{SPACE}*[{_LETTER}]+|{SPACE}*[^{_LETTER}{SPACE}]+|{SPACE}+" if apart else f"{SPACE}+[^{SPACE}]*"
        self.cut = re.compile(f"{SPACE}{{{_WIDE}}}(?={SPACE})|{word}").findall
        self.texts = ["" if t == CONTROL else model["unknown"] if t == UNKNOWN else p.replace(SPACE, " ") for p, t in zip(pieces, types, strict=True)]
        self.numbers = [str(i) for i in range(self.size)]
        self.ints = list(range(self.size))
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes.tolist())}
        self.control = {i for i, t in enumerate(types) if t == CONTROL}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _key(self, a, b):
        return a * (self.size + _CODES) + b

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the merge table; ``none`` where there is no such merge."""
        key = self._key(left.astype(np.int64), right.astype(np.int64))
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, self.none).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words behind one another, symbols per word) after all rounds.  Words are not empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym = self.symbol[codes]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        at = np.arange(len(sym))
        slot = np.full(len(sym), self.none, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        slot[inner] = self._slots(sym[inner], sym[inner + 1])
        out_word, out_sym = [], []
        while len(sym):
            rank = self.rank[slot]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            going = best != _NONE
            if not going.all():
                out_word.append(word[~going])
                out_sym.append(sym[~going])
                sym, word, at, slot, rank, best = (x[going] for x in (sym, word, at, slot, rank, best))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # neighbouring hits overlap: of a run every second one, beginning with the first
            places = np.arange(len(hit))
            begins = np.r_[True, np.diff(hit) != 1]
            keep = (places - np.maximum.accumulate(np.where(begins, places, 0))) % 2 == 0
            risky = self.risky[best[hit]]
            if risky.any():
                apart = np.r_[True, (np.diff(word[hit]) != 0) | (np.diff(at[hit]) >= self.reach)]
                keep = np.where(risky, apart, keep)
            take = hit[keep]
            sym[take] = self.merged[slot[take]]
            left = np.ones(len(sym), dtype=bool)
            left[take + 1] = False
            sym, word, at, slot = (x[left] for x in (sym, word, at, slot))
            new = take - np.arange(len(take))
            new = np.unique(np.r_[new, new[new > 0] - 1])
            slot[new] = self.none
            pair = new[new + 1 < len(sym)]
            pair = pair[word[pair] == word[pair + 1]]
            slot[pair] = self._slots(sym[pair], sym[pair + 1])
        if not out_word:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, sym = np.concatenate(out_word), np.concatenate(out_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        sym, counts = self.merge(words)
        ends = np.cumsum(counts).tolist()
        flat, ints, size, begin = sym.tolist(), self.ints, self.size, 0
        foreign = bool(len(sym)) and int(sym.max()) >= size
        for w, end in zip(words, ends, strict=True):
            own = flat[begin:end]
            if foreign and max(own) >= size:
                own = [x for s in own for x in ((s,) if s < size else self.bytes[list(chr(s - size).encode("utf-8"))].tolist())]
            self.cache[w] = tuple([ints[x] for x in own])
            begin = end

    def words(self, text: str | None) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts; the distinct new words of all texts are merged together."""
        split = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        missing = set(chain.from_iterable(split)).difference(self.cache)
        if missing:
            self._learn(list(missing))
        get = self.cache.__getitem__
        out = [list(chain.from_iterable(map(get, ws))) for ws in split]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        else:
            for w in missing:
                if len(w) > LONG_WORD:
                    del self.cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The pieces' strings joined, the space that encoding puts in front taken away; byte pieces are read as UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
            bare = True
        else:
            parts, run, bare = [], bytearray(), None
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    bare = False if bare is None else bare
                    continue
                if run:
                    parts.append(_utf8(bytes(run)))
                    run.clear()
                bare = True if bare is None and i not in self.control else bare
                parts.append(self.texts[i])
            text = "".join(parts) + _utf8(bytes(run))
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if bare and first is not None and text[:1] == " " and self.texts[first][:1] == " " and first != 0 else text


def _utf8(raw: bytes) -> str:
    """UTF-8 text; every byte that is not part of a valid character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return raw[: e.start].decode("utf-8") + "�" + _utf8(raw[e.start + 1 :])


def _id_type(df: DataFrame) -> T.DataType:
    return df.schema["id"].dataType


def piece_encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    src = pick(df, id_col, text_col)
    small_batches(df.sparkSession)
    shared = Shared(df.sparkSession, read_model(model_path), Pieces)

    def run(batches):
        no_cycles()
        model = shared.get()
        for batch in batches:
            ids = model.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def piece_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded string of every id list; null is an empty list."""
    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    small_batches(df.sparkSession)
    shared = Shared(df.sparkSession, read_model(model_path), Pieces)

    def run(batches):
        no_cycles()
        model = shared.get()
        for batch in batches:
            out = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("text", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def piece_round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts.

    The digests are of the decimal ids joined by commas and of the decoded text, both
    in UTF-8.  Nothing is shuffled.
    """
    src = pick(df, id_col, text_col)
    small_batches(df.sparkSession)
    shared = Shared(df.sparkSession, read_model(model_path), Pieces)

    def run(batches):
        no_cycles()
        model = shared.get()
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            ids = model.encode(batch.column(1).to_pylist())
            number = model.numbers.__getitem__
            a = [sha(",".join(map(number, x))) for x in ids]
            b = [sha(model.decode(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
