"""SentencePiece encoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from paytrail.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "▁", " ", "  ", "   ", "1", "É", "\n", "\t", "日本", "😀", "the", "ing", " of ", "-", "----", "=", "....", "\0", "<0x41>", "<s>", "</s>", "<unk>", "é", "ß", "\r\n", "versions", "here", "usage", "ieve", "\u3000", "aa", "door"]
TEXTS = ["", None, " ", "Hello, world!", "  a  b ", "▁x▁", "the the the", "the the the", "ab" * 30_000, "-" * 5000 + "=" * 300, " " * 3000 + "x", "日本語" * 500]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.read_model(PATH))


def test_rounds_equal_the_library(model):
    r = random.Random(7)
    texts = TEXTS + ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [" " * n + "x" for n in range(70)] + ["y" + " " * n for n in range(70)] + ["-" * n for n in range(70)] + ["." * n + "a" for n in range(40)]
    texts += ["".join(r.choice(letters) for _ in range(2000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ersion", "-=. ")]
    for t, got in zip(texts, model.encode(texts), strict=True):
        assert got == LIB.encode(t or ""), ascii(t)[:80]
        assert model.decode(got) == LIB.decode(got)


def test_decoding_any_ids_equals_the_library(model):
    r = random.Random(8)
    for _ in range(1500):
        ids = [r.choice([0, 1, 2, 259, 28705, r.randint(3, 258), r.randint(200, 258), r.randint(0, 31999)]) for _ in range(r.randint(0, 6))]
        assert model.decode(ids) == LIB.decode(ids), ids


def test_the_cache_changes_nothing_and_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    for t in TEXTS:
        assert model.encode([t])[0] == LIB.encode(t or "")
        assert len(model.cache) <= 3 and all(len(w) <= pieces.LONG_WORD for w in model.cache)


def test_encode_decode_digests(spark):
    rows = [*enumerate(TEXTS), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as id", "2 as n_tokens")
    texts = dict(rows)
    enc = {r.doc_id: r.ids for r in pieces.piece_encode(df, PATH).collect()}
    dec = {r.doc_id: r.text for r in pieces.piece_decode(pieces.piece_encode(df, PATH), PATH).collect()}
    got = pieces.piece_round_trip(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = LIB.encode(texts[r.doc_id] or "")
        assert enc[r.doc_id] == want and r.n_tokens == len(want) and dec[r.doc_id] == LIB.decode(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(want).encode()).hexdigest()
    assert pieces.piece_round_trip(df.limit(0), PATH).count() == 0


def test_other_models_are_refused():
    plain = pieces.read_model(PATH)
    with pytest.raises(ValueError):
        pieces.Pieces(plain | {"types": [4, *plain["types"][1:]]})
    with pytest.raises(ValueError):
        pieces.Pieces(plain | {"pieces": [*plain["pieces"][:-1], "x▁"]})
