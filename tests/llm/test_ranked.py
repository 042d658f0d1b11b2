"""Ranked search against plain scores, and its bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from paytrail.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    length = sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for q, text in sorted(set(queries), key=repr):
        found = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                found.append((i, s))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(q, r, i, s) for r, (i, s) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(4000)] + ["The", "the", "É", "été", "a1"]
    docs = [(i, " ".join(r.choice(words) for _ in range(int(r.paretovariate(0.8)) + 1))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(7, docs[7][1])] * 3
    docs += [(None, "w1 w2 the"), (None, None), (2000, ""), (2001, "!!!"), (2002, "THE the The " * 5000)]
    queries = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(25)]
    return docs, queries + [(3, "été, THE"), (3, "été, THE"), (None, docs[5][1]), (50, ""), (51, None), (52, "nowhere")]


@pytest.mark.parametrize(("k", "lot", "few"), [(50, ranked.LOT_TERMS, 500_000), (3, 20, 500_000), (7, ranked.LOT_TERMS, 1)])
def test_search_equals_brute_force(spark, monkeypatch, k, lot, few):
    monkeypatch.setattr(ranked, "BROADCAST_KEYS", few)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 64)
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'q' as query", "2 as score").repartition(6)
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "0 as rank")
    got = sorted(map(tuple, ranked.search(d, q, k=k, lot_terms=lot).collect()), key=repr)
    assert got == brute(docs, queries, k)


def test_a_kept_index_serves_other_queries_and_empty_tables(spark):
    docs, queries = corpus(4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = ranked.build_index(d)
    for part in (queries[:5], queries[5:9]):
        q = spark.createDataFrame(part, "item_id long, text string")
        assert sorted(map(tuple, ranked.search(d, q, k=9, index=index).collect()), key=repr) == brute(docs, part, 9)
    q = spark.createDataFrame(queries, "item_id long, text string")
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0


def test_bounds_are_never_under_the_scores():
    docs, queries = corpus(5)
    hasher, block, texts = ranked.WordHash(), ranked.Waiting(), {}
    for row, (i, t) in enumerate(docs):
        if words := ranked.words_of(t):
            block.add((i, row, len(words), *np.unique(hasher(words), return_counts=True)))
            texts[row] = t
    lot = ranked.Lot([(q, sorted(set(ranked.words_of(t)))) for q, t in queries if ranked.words_of(t)])
    held = Counter(w for t in texts.values() for w in set(ranked.words_of(t)))
    lot.weigh(len(texts), sum(len(ranked.words_of(t)) for t in texts.values()), {i: held[w] for i, w in enumerate(lot.words)})
    opened = ranked.Opened(lot)
    _, rows, n, widths, maps, top = block.block()
    bounds = opened.bounds(np.array(n), widths, maps, top)
    over = 0
    for at, row in enumerate(rows):
        scores = opened.scores(texts[row], list(range(len(lot.ids))))
        assert all(b >= s for b, s in zip(bounds[:, at].tolist(), scores, strict=True))
        over += sum(b > s for b, s in zip(bounds[:, at].tolist(), scores, strict=True))
    assert over < bounds.size / 2  # and they are bounds worth having
