"""Decontamination, sharding, WARC packages and the toxicity grammar against plain versions."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from paytrail.llm import decontam, sharding, toxicity, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(text, items, size):
    words, hit, found = WORD.findall(ascii_lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(ascii_lower(t))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "one two three four five"), (10, "Alpha BETA gamma"), (2, "xx"), (3, ""), (4, None), (1, "one two three four five"), (None, "été Straße naïve"), (5, "é è ê")]
TEXTS = ["zero one two three four five six", "alpha, beta; gamma!", "XX xx yy", "", None, "ÉTÉ été straße NAÏVE", "one two three x two three four", "été Straße naïve " * 3, "!!!"]


@pytest.mark.parametrize("chunk", [120, 1_000_000])
def test_decontamination_equals_brute_force(spark, chunk):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (0, TEXTS[0], 8), (None, TEXTS[0], 9), (None, "clean", 9)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.scan(docs, bench, size=3, chunk_bytes=chunk).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, list(r.item_ids)) == brute_hits(TEXTS[r.doc_id], ITEMS, 3), r.doc_id
            assert r.n_items == len(r.item_ids) and r.contaminated == (r.n_hit > 0)
    assert sorted((r.n_words, r.n_hit) for r in got if r.doc_id is None) == [(1, 0), (7, 5)]
    left = decontam.decontaminate(docs, bench, size=3, chunk_bytes=chunk)
    assert left.columns == docs.columns
    clean = [i for i, t in enumerate(TEXTS) if not brute_hits(t, ITEMS, 3)[1]]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, *clean]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, mode="spans", size=3, chunk_bytes=chunk).collect()}
    assert cut[0] == "zero  six" and cut[4] is None and cut[8] == "!!!"


def test_decontamination_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs.limit(0), bench, chunk_bytes=120).count() == 0
    long = spark.createDataFrame([(1, "filler word " * 200_000 + "one two three " + "x " * 100_000), (2, "y" * 3_000_000)], "doc_id long, text string")
    for chunk in (150, 1_000_000):
        assert sorted(tuple(r)[:4] for r in decontam.scan(long, bench, size=3, chunk_bytes=chunk).collect()) == [(1, 500_003, 3, 1), (2, 1, 0, 0)]


def test_windows_are_cut_and_chunked_in_spark(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.windows(bench, 3)
    assert sorted(map(tuple, found.collect()))[:2] == [(1, "xx", "2"), (3, "alpha beta gamma", "10")]
    assert found.count() == 3 + 1 + 1 + 1 + 1
    parts = decontam._chunks(found, 60)
    assert len(parts) > 1 and sorted(r for p in parts for r in map(tuple, p.collect())) == sorted(map(tuple, found.collect()))


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "_hash", lambda grams: np.zeros(len(grams), dtype=np.uint64))
    packed = decontam.pack(pa.table({"n": pa.array([2, 2, 2], pa.int32()), "words": ["a b", "b c", "a b"], "item": ["1", "2", "3"]}))
    assert decontam.Windows(packed).scan(["x a b c", "b c", "c b", None]) == [(4, [[1, 4]], ["1", "2", "3"]), (2, [[0, 2]], ["2"]), (2, [], []), (0, [], [])]


def brute_shard(key, weights):
    import math

    def cost(i, w):
        h = xxhash.xxh64_intdigest(str(key).encode(), seed=42)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / w
    return min(range(len(weights)), key=lambda i: cost(i, weights[i]))


def test_rendezvous_shards_slots_and_growth(spark):
    rows = [(i, f"text {i % 50}" if i % 9 else None) for i in range(400)] + [(3, "twice"), (3, "twice"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as shard", "5 as slot")
    got = sharding.with_slots(sharding.assign(df, [1.0] * 16, [1.0] * 17), sub_buckets=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        if r.doc_id is not None:
            assert r.shard == brute_shard(r.doc_id, [1.0] * 16) and r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    first = next(r for r in got if r.doc_id == 1)
    assert first.size == len(b"text 1") + 1 and first.text_crc32 == zlib.crc32(b"text 1") and first.law == "key"
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 9} == {(1, 0)}
    heavy = [r.shard for r in sharding.assign(spark.range(2000).selectExpr("id as doc_id", "'' as text"), [1.0, 3.0]).collect()]
    assert 0.7 < sum(heavy) / 2000 < 0.8
    assert sharding.with_slots(sharding.assign(df.limit(0), [1.0])).count() == 0


@pytest.mark.parametrize(("size", "zip64"), [(1, False), (32 << 20, True)])
def test_warc_packages(spark, size, zip64):
    pages = [(5, "u5", "same"), (2, "u2", "same"), (9, "u 9\n", "other é"), (7, "u7", ""), (8, None, None), (1, "u1", "z" * 200_000), (11, "u5", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as n", "'q' as sha1")
    got = {r.page_id: r for r in warc.warc_round_trip(df, package_bytes=size, zip64=zip64).collect()}
    assert len(got) == len(pages)
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    for i, _, html in pages:
        raw, r = (html or "").encode(), got[i]
        head = first[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if head == i else ("revisit", head))
    plain = warc.warc_round_trip(df, min_bytes=5).collect()
    assert all(r.record_type == "response" for r in plain)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members_are_found_and_readable_by_others(zip64):
    raw = warc.zip_bytes([("a/b", b"12345"), ("ü", b""), ("c", b"x" * 70_000)], zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read("c") == b"x" * 70_000 and z.namelist() == ["a/b", "ü", "c"]
    package = warc.ZipRanges(Memory(raw))
    at, n = package.locate("a/b")
    assert raw[at : at + n] == b"12345" and package.locate("ü")[1] == 0
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(ValueError, match="stored"):
        warc.ZipRanges(Memory(packed.getvalue()))


def test_grammar_composes_negation_reported_speech_and_target():
    g = toxicity.Grammar({"idiot$": 2.0, "lowei": 2.0})
    f = lambda t: {k for k in g.features(t) if k != "DENSITY"}
    assert f("an idiot here") == {"INSULT"} and f("you big idiot") == {"INSULT+TGT"} and f("idiot, are you") == {"INSULT+TGT"}
    assert f("never an idiot") == {"INSULT+NEG"} and f("they said he was an idiot") == {"INSULT+REP"}
    assert f("they said it. idiot") == {"INSULT"} and f("Loweischaft!") == {"INSULT"}
    assert f("idiotic eloweis") == set() and f("") == set() and f(None) == set()
    assert f("we kill time") == {"THREAT"} and f("i kill you") == {"THREAT+TGT"}
    assert g.score("you idiot") > g.score("they said idiot") and g.score("i kill you") > 0.5 > g.score("we kill time")


def test_learned_stems_separate_held_out_texts(spark):
    docs, labels, pick = [], [], random.Random(9)
    for i in range(900):
        toxic = i % 3 == 0
        words = ["".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(25)]
        if toxic:
            words.insert(5, ["blurgh", "snarkish" + "abcde"[i % 5]][i % 2])
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    docs += [(5000, None, None), (5001, "", "xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    grammar = toxicity.train(d, spark.createDataFrame([*labels, (None, 1), (7, None), (5000, 1), (5000, 0)], "doc_id long, toxic int"))
    assert "blurgh$" in grammar.stems
    score = {r.doc_id: r.score for r in toxicity.score(d, grammar).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == (i % 3 == 0) for i in held) / len(held) > 0.97
    assert score[5000] == score[5001] < 0.5
    left = toxicity.without_toxic(d, grammar)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, s in score.items() if s < 0.5)
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.stems == {} and toxicity.score(d.limit(0), none).count() == 0


def test_negated_and_reported_threats_are_no_direct_ones():
    g = toxicity.Grammar({"idiot": 2.0})
    kinds = lambda t: set(g.features(t)) - {"DENSITY"}
    assert kinds("i will kill you") == kinds("you i kill") == {"THREAT+TGT"}
    assert kinds("do not kill you") == {"THREAT+NEG"} and kinds("he said he would kill you") == {"THREAT+REP"}
    assert kinds("you never hurt") == {"THREAT+NEG"} and kinds("kill the process") == {"THREAT"}
    assert kinds("no idiot") == {"INSULT+NEG"} and kinds("she wrote: kill you") == {"THREAT+TGT"}  # a new clause
    direct = g.score("i will kill you")
    assert all(g.score(t) < 0.5 < direct for t in ("do not kill you", "he said he would kill you", "kill the process"))


def test_toxicity_of_repeated_null_and_very_long_rows(spark):
    r = random.Random(2)
    filler = lambda n: " ".join("".join(r.choice("bdfgklmnr") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    bad = "you vilwretch " + filler(9)
    rows = [(i, f"{filler(9)} you vilwretch {filler(9)}") for i in range(60)] + [(i, filler(20)) for i in range(100, 300)]
    extra = [(None, bad), (None, None), (1, rows[1][1]), (500, "x " * 50_000 + bad), (501, "")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as id")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows] + [(None, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1][0] == by[1][1] and min(by[3]) > 0.5 > max(by[150]) and by[501] == [min(by[None])]
    assert toxicity.without_toxic(docs, toxicity.train(docs, labels)).columns == docs.columns


def test_a_worker_gives_its_memory_back_to_the_next_operator():
    """What an operator held, and the free memory that the allocator keeps, is gone when the next one starts."""
    import subprocess
    import sys

    from paytrail.llm import common

    code = """
import re
from paytrail.llm import common
def mb():
    return int(re.search(r"Rss:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
held = common.held("a", lambda: [bytes(50_000) for _ in range(4000)])
last = [bytes(60_000)]  # keeps the top of the heap in use
full = mb()
del held
common._LIBC[1] = 0.0
common.release()
assert full - mb() > 150, (full, mb())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=common.__file__.rsplit("/paytrail/", 1)[0])
