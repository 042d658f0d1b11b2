"""Stupid backoff and the Jaccard join against brute force; the pipeline on odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paytrail.llm import backoff, jaccard_join
from paytrail.llm.common import words_of


def brute_backoff(texts, order, low, alpha):
    docs = [words_of(t) for t in texts]
    c = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))

    def s(gram):
        if len(gram) == 1:
            return math.log(c[gram] / total)
        return math.log(c[gram] / c[gram[:-1]]) if c[gram] >= low else math.log(alpha) + s(gram[1:])
    return [sum(s(tuple(d[max(0, i - order + 1) : i + 1])) for i in range(len(d))) for d in docs]


@pytest.mark.parametrize(("order", "block"), [(3, 2_000_000), (3, 20), (1, 50), (4, 100)])
def test_backoff_equals_brute_force(spark, order, block):
    r = random.Random(2)
    texts = [" ".join(r.choice("a b c d e É x1".split()) for _ in range(r.randint(0, 40))) for _ in range(30)] + ["", None, "!!!", "same same", "same same"]
    want = brute_backoff(texts, order, 2, 0.4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'k' as kind", "1 as block")
    got = backoff.scores(df, order=order, block_words=block, shards=5).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.n_words == len(words_of(texts[x.doc_id])) and x.log_score == pytest.approx(want[x.doc_id], abs=1e-6)
        assert x.score is None if x.n_words == 0 else x.score == pytest.approx(want[x.doc_id] / x.n_words)
    assert backoff.scores(df.limit(0)).count() == 0


def test_backoff_shards_follow_the_words(spark):
    """More shards for more words change no score."""
    texts = ["a b c a b c d", "a b c", "d a b"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = ({r.doc_id: r.log_score for r in backoff.scores(df, shard_words=n).collect()} for n in (4_000_000, 3))
    assert few == pytest.approx(many) and len(few) == 60


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = base[:]
            copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    big = [word() for _ in range(150)]
    for i in range(60):  # a group larger than a bucket, all different
        copy = big[:]
        copy[i] = word()
        texts.append(" ".join(copy))
    notice = " ".join(word() for _ in range(8))
    texts += [notice + " " + " ".join(word() for _ in range(80)) for _ in range(50)]
    texts += ["one two", "one two", "One, two!", "", None, "?!", "?!", texts[0], texts[0].upper(), "one two three"]
    return texts


def brute_classes(texts):
    hasher = jaccard_join.WordHash()
    sets = [set(jaccard_join.shingles(t, hasher).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    n_links = [0] * len(texts)
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n_links[i] += 1
                n_links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], n_links


def test_classes_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(4)
    want, n_links = brute_classes(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(df).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    for i in range(len(texts)):
        if sizes[want[i]] <= jaccard_join.BUCKET:
            assert got[i].n_links == n_links[i]
        else:
            assert 1 <= got[i].n_links <= n_links[i]
    left = jaccard_join.one_per_class(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def copies_of_one(n=300, words=400, changed=7):
    """An original and copies that are links of it more than of one another."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(n):
        copy = base[:]
        for i in r.sample(range(words), changed):
            copy[i] = word()
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("settings", [{}, {"block": 64}])
def test_many_copies_around_one_original(spark, settings):
    """Hot nodes, whole or in blocks: the classes of all exact links."""
    texts = copies_of_one()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, _ = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(df, **settings).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < 10


@pytest.mark.parametrize("settings", [{}, {"block": 16}])
def test_links_of_large_groups_are_counted(spark, settings):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, n_links = brute_classes(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(df, **settings).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == list(zip(want, n_links, strict=True))


def test_one_row_of_each_class_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(x + str(i) for i in range(20)) for x in "abcde")
    rows = [(None, a), (None, a), (None, b), (4, c), (4, d), (4, d), (5, d), (7, e), (None, e)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    left = jaccard_join.one_per_class(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, a), (0, b), (4, c), (4, d), (7, e)])


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    assert {bytes(r.root) for r in jaccard_join.components(chain).collect()} == {bytes([0])}
    with pytest.raises(RuntimeError):
        jaccard_join.components(chain, max_rounds=1)


def test_long_texts_and_contraction_change_nothing(spark):
    """Groups found in the first runs, strays that only later runs can find, and very long texts."""
    r = random.Random(5)
    long = " ".join(f"w{r.randint(0, 9999)}" for _ in range(20_000))
    texts = corpus() + [long, long + " tail", long.replace("w1", "v1", 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, n_links = brute_classes(texts)
    got = {x.doc_id: x for x in jaccard_join.near_duplicates(df, bucket=4, block=16).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == list(zip(want, n_links, strict=True))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other words here")], "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == 4 and sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (0, 4, 2), (4, 4, 2), (4, 4, 2)]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    texts = [t for t in corpus() if t and len(t.split()) > 20][:80]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(texts[5].split()[:14])), (2, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id for r in docs.collect()}
    assert 5 not in kept and {900, 901} & kept and len(kept) > 10
    assert docs.filter(F.col("n_tokens") > 0).count() > 10
