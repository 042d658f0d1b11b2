"""BPE and token files against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paytrail.llm import bpe, tokenio

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
TEXTS = ["", None, "Hello, WORLD! it's 42 dogs'LL", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ é é \x1c x\x85y", "!!!", " \n\t ", "ab" * 30_000,
         "thouhe$$$ ing&&& || a.b,c", "naïve, déjà. ñandú", "the the the", "the the the"]


def fuzz(n=400, seed=3):
    r = random.Random(seed)
    parts = ["a", "'s", " ", "1", "É", "<|endoftext|>", "<|", "Σ", "İ", "é", "'LL", "\x1c", "\x85", "ſ", "ab", " of ", "$", "²", "_", "\n", "日本", "😀", "ß", "the,"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_queue_merges_equal_the_library():
    model = bpe.Bpe(open(PATH, encoding="utf-8").read())
    for t in TEXTS + fuzz():
        assert model.encode(t) == ids(t), ascii(t)
        assert model.decode(ids(t)) == LIB.decode(ids(t), skip_special_tokens=False)


def test_library_encoder_equals_whole_texts():
    encode = tokenio.LibraryEncoder(open(PATH, encoding="utf-8").read())
    texts = TEXTS + fuzz(seed=4)
    for t, raw in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids(t), ascii(t)


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 0, 7], list(range(300)) * 3])
def test_variable_length_coding_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    control, data = tokenio.pack(v)
    got = tokenio.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v))
    assert got.tolist() == values
    docs, lengths, ids_ = tokenio.parse(tokenio.file_bytes([None, 5], [len(v), 0], v))
    assert docs == [None, 5] and lengths.tolist() == [len(v), 0] and ids_.tolist() == values


def test_encode_decode_digests(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as id")
    enc = {r.doc_id: r.ids for r in bpe.bpe_encode(df, PATH).collect()}
    dec = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()}
    for r in bpe.bpe_round_trip(df, PATH).collect():
        want = ids(TEXTS[r.doc_id])
        assert enc[r.doc_id] == want and r.n_tokens == len(want)
        assert dec[r.doc_id] == LIB.decode(want, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(dec[r.doc_id].encode()).hexdigest()
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("file_ids", [50, 4_000_000])
def test_token_files_hold_all_documents_in_order(spark, file_ids):
    rows = [(i * 3 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (1, "again"), (1, "again")]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "0 as start", "'f' as file")
    got = sorted(tokenio.token_files(df, PATH, file_ids=file_ids).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    before = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(np.array([*ids(t), 2], dtype="<u4").tobytes())
    for r in got:
        assert r.start == before
        before += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in {(len(b) // 4, zlib.crc32(b)) for b in texts[r.doc_id]}
    assert tokenio.token_files(df.limit(0), PATH).count() == 0
