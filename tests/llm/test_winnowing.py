"""Winnowing against a plain Python version; neighbours, edited texts, edge cases."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paytrail.llm import winnowing

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def rot(x, b):
    b %= 64
    return ((x << b) | (x >> (64 - b))) & M if b else x


def brute(text, k, w):
    text = text or ""
    words = re.findall(r"[^\W_]+", text.lower()) or ([text] if text else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in words]
    if not h:
        return [], []
    n = min(k, len(h))
    grams = []
    for i in range(len(h) - n + 1):
        v = 0
        for x in h[i : i + n]:
            v = rot(v, 1) ^ x
        grams.append(signed(v))
    at = set()
    for i in range(max(1, len(grams) - w + 1)):
        win = grams[i : i + w]
        low = min(win)
        at.add(i + max(j for j, x in enumerate(win) if x == low))
    at = sorted(at)
    return [grams[i] for i in at], at


def jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


TEXTS = ["a b c d e f g h i j k l m n o p", "same same same same same same same same same", "", None, "!!!", "one", "Ünï cödé words hére and thére", "x " * 300,
         "a b c d e f g h i j k l m n o p", "the quick brown fox jumps over the lazy dog " * 9, "tail"]


@pytest.mark.parametrize(("k", "w"), [(5, 16), (2, 3), (1, 1)])
def test_kept_hashes_and_positions_equal_the_plain_version(spark, k, w):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in winnowing.fingerprints(df, k=k, window=w).collect():
        assert (list(r.hashes), list(r.positions)) == brute(TEXTS[r.doc_id], k, w), r.doc_id


def test_edited_texts_and_likeness_follow_the_next_document(spark):
    rows = [(i * 7 - 3, t, "en", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string, fp string, id int").repartition(3)
    got = {r.doc_id: r for r in winnowing.compare_edited(df, k=2, window=3).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for t in TEXTS]
    for i, (doc, *_) in enumerate(rows):
        own, nxt = texts[i], texts[(i + 1) % len(texts)]
        q = len(own) // 4
        edited = own[: len(own) - q] + nxt[:q]
        r = got[doc]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(brute(own, 2, 3)[0], brute(edited, 2, 3)[0]))
        assert r.near_next == pytest.approx(jaccard(brute(own, 2, 3)[0], brute(nxt, 2, 3)[0]))
        assert (r.fingerprint == got[rows[0][0]].fingerprint) == (brute(own, 2, 3) == brute(texts[0], 2, 3))


def test_null_ids_repeated_rows_single_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "z y x"), (1, "a b"), (1, "a b"), (2, "c d e f")], "doc_id long, text string")
    rows = winnowing.compare_edited(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in rows) == [-1, 1, 1, 2]
    assert [r.near_next for r in rows if r.doc_id == 1].count(1.0) == 1
    one = winnowing.compare_edited(df.limit(0).unionAll(spark.createDataFrame([(5, "abcd")], "doc_id long, text string"))).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert winnowing.compare_edited(df.limit(0)).count() == 0


def test_shared_run_of_window_plus_k_words_shares_a_hash(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, "p q r " + shared + " s t"), (2, "u " + shared + " v w x y")], "doc_id long, text string")
    a, b = (set(r.hashes) for r in winnowing.fingerprints(df).collect())
    assert a & b


@pytest.mark.parametrize("lots", [2, 7, 40])
def test_neighbours_equal_a_sort_with_hot_ids_null_ids_and_many_lots(spark, lots):
    rows = [(i % 90 * 11 - 300, f"t{i}") for i in range(180)] + [(5, f"hot {i}") for i in range(150)] + [(None, f"none {i}") for i in range(120)] + [(7, None), (7, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = winnowing.with_next(df, {"n": F.length("text")}, lots).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)), r[1] is not None, r[1] or "")
    order = sorted(rows, key=key)
    wanted = sorted((key(r), key(n)[2:]) for r, n in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((key((r.id, r.text)), key((None, r.next_text))[2:]) for r in got) == wanted
    assert all(r.next_n == (None if r.next_text is None else len(r.next_text)) for r in got)


def test_a_hot_id_is_dealt_over_several_lots(spark):
    rows = [(i, f"t{i}") for i in range(100)] + [(50, f"hot {i}") for i in range(100)] + [(None, f"none {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("hash", F.xxhash64("text"))
    lot = winnowing._lot(winnowing._layout(df, 30))
    size = {r.lot: r["count"] for r in df.groupBy(lot.alias("lot")).count().collect()}
    assert max(size.values()) <= 40 and len(size) >= 25
