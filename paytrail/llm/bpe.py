"""BPE encoding and decoding with a given public vocabulary (nothing is trained here).

Encoding is the textbook priority-queue form: a word's symbols form a doubly
linked list, a heap holds the merge candidates by (rank, position), and a popped
candidate whose symbols have changed since is stale and skipped.  Words repeat,
so each Python worker keeps a bounded cache of encoded words; the cache changes
the time only.  Decoding looks the ids up and joins the vocabulary strings.

Letters added to Unicode after version 15 are split as the ``regex`` library
knows them, which may differ from an encoder built on older tables.

Defined results: a null text is an empty text (no ids, empty decoded text);
repeated rows and ties give one output row each; an empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paytrail.llm.common import Shared, no_cycles, pick, small_batches

# cached tokens and the longest that is kept: their product bounds the cache's bytes
CACHE_WORDS, LONG_TOKEN = 300_000, 64
# split() takes these for white space, the Unicode property does not
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class _Learned(dict):
    """token -> ids; a token that is not there yet is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, token: str) -> tuple[int, ...]:
        return self.encode(token)


class Bpe:
    """A word-end BPE vocabulary: NFC, lower case, split by its pattern, byte-level symbols."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in alphabet]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s of the file's pattern is the Unicode White_Space property
        pattern = split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache = _Learned(self.token)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, until none applies."""
        n = len(ids)
        if n < 2:
            return ids
        merges, nxt, prv = self.merges, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, new = pop(heap)
            j = nxt[i]
            # stale: the symbol is gone, is the last one, or the pair has changed
            if ids[i] < 0 or j < 0 or (m := merges.get((ids[i], ids[j]))) is None or m[1] != new:
                continue
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                if m := merges.get((new, ids[k])):
                    push(heap, (m[0], i, m[1]))
            h = prv[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                push(heap, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return tuple(self.merge([x for x in symbols if x is not None]))

    def plain(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids, token by token, of a text without special tokens.

        No word spans white space, so the cache is kept by white-space token.
        """
        words = self.words
        if not text.isascii():
            # the file's lower-casing goes character by character: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _SEPARATORS.search(text):
            return map(self.word, words(text.lower()))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return map(self.cache.__getitem__, text.lower().split())

    def token(self, token: str) -> tuple[int, ...]:
        """Ids of a white-space token, kept."""
        cache, pieces = self.cache, self.words(token)
        if len(token) > LONG_TOKEN:
            return tuple(chain.from_iterable(map(self.word, pieces)))
        if pieces == [token]:
            cache[token] = out = self.word(token)
            return out
        ids: list[int] = []
        for piece in pieces:  # a word without its punctuation is a token of its own
            if (known := cache.get(piece)) is None:
                known = cache[piece] = self.word(piece)
            ids += known
        cache[token] = out = tuple(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or "<" not in text:
            return list(chain.from_iterable(self.plain(text)))
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(self.plain(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by one space, as for a file without a decoder; unknown ids are left out."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


def _definition(spark, path: str) -> Shared:
    """The tokenizer file's text, broadcast once; its size is that of a vocabulary.  One model per Python worker."""
    with open(path, encoding="utf-8") as f:
        return Shared(spark, f.read(), Bpe)


def _id_type(df: DataFrame) -> T.DataType:
    return df.schema["id"].dataType


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    src = pick(df, id_col, text_col)
    small_batches(df.sparkSession)
    shared = _definition(df.sparkSession, tokenizer_path)

    def run(batches):
        no_cycles()
        model = shared.get()
        for batch in batches:
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the decoded string of every id list; null is an empty list."""
    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    small_batches(df.sparkSession)
    shared = _definition(df.sparkSession, tokenizer_path)

    def run(batches):
        no_cycles()
        model = shared.get()
        for batch in batches:
            out = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("text", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def bpe_round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts.

    The digests are of the decimal ids joined by one space and of the decoded
    text, both in UTF-8.  Nothing is shuffled.
    """
    src = pick(df, id_col, text_col)
    small_batches(df.sparkSession)
    shared = _definition(df.sparkSession, tokenizer_path)

    def run(batches):
        no_cycles()
        model = shared.get()
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = model.encode(text)
                n.append(len(ids))
                a.append(sha(" ".join(map(str, ids))))
                b.append(sha(model.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("id", _id_type(src)), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)



