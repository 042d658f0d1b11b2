"""Cross-tokenizer alignment against whole texts and plain counters."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paytrail.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """The same results from whole texts, one by one and with plain counters."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    enc = alignment.Encoders(A, B)
    groups = []
    for t in texts:
        xs, ys = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or not b"".join(enc.bytes_a[i] for i in xs) == b"".join(enc.bytes_b[i] for i in ys) == (" " + t).encode():
            groups.append([])
            continue
        ends = [np.cumsum([len(tokens[i]) for i in ids]).tolist() for tokens, ids in ((enc.bytes_a, xs), (enc.bytes_b, ys))]
        both, own = sorted(set(ends[0]) & set(ends[1])), []
        low = 0
        for e in both:
            own.append(([i for i, x in zip(xs, ends[0], strict=True) if low < x <= e], [i for i, x in zip(ys, ends[1], strict=True) if low < x <= e]))
            low = e
        groups.append(own)
    links = [[(x, y) for g in own for x in g[0] for y in g[1]] for own in groups]
    counts = Counter(p for own in links for p in set(own))
    best: dict[int, int] = {}
    for (x, _), c in counts.items():
        best[x] = max(best.get(x, 0), c)
    return [(sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls),
             hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in own).encode()).hexdigest() if own else "") for own, ls in zip(groups, links, strict=True)]


def texts():
    r = random.Random(11)
    parts = ["it's", "'s", "don'T", " ", "  ", "\n", "\n\n", "\t", ".", ", ", "Word", " word", "1984", "é", "ñandú", "日本", "😀", "<|endoftext|>", "</s>", "\u3000", "\x85", "\x1c", "aaaa", "----", "_", "Привет", "x", "ſ", "ª", "ǅ", "\u0301"]
    fuzz = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(250)]
    return ["", None, " ", "the of and", "the of and", "a▁b", "the\0of", "ab" * 3000, "x" * 900 + " " * 500 + "y", "日本語" * 300, *fuzz]


@pytest.mark.parametrize("lot", [alignment.LOT_PAIRS, 300])
def test_alignment_equals_brute_force(spark, lot, monkeypatch):
    ts = texts()
    want = brute(ts)
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(ts)], "doc_id long, text string").selectExpr("*", "'k' as keys", "1 as shard", "2 as id", "3 as row").repartition(5)
    got = alignment.align(df, A, B, lot_pairs=lot).collect()
    assert len(got) == len(ts)
    for r in got:
        i = r.doc_id or 0
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[i], ascii(ts[i])
    assert alignment.align(df.limit(0), A, B).count() == 0


def test_repeated_rows_and_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "a▁b"), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in alignment.align(df, A, B).collect())
    assert got[0] == got[1] and got[0][6] == 2 * got[0][4]  # every link is in two documents
    assert got[2] == (2, 0, 0, 0, 0, 0, 0, "") and got[3] == (3, 0, 0, 0, 0, 0, 0, "")
    assert alignment.align(df.filter("doc_id > 1"), A, B).count() == 2


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    aligner = alignment.Aligner(alignment.Encoders(A, B))
    whole = aligner.align([" aaaa bbbb", "cccc"])
    a, ga, b, gb, piece, _ = whole
    one = Counter(zip(*(x.tolist() for x in (aligner.links(a, ga, b, gb, len(piece))[0][0], aligner.links(a, ga, b, gb, len(piece))[0][2])), strict=True))
    monkeypatch.setattr(alignment, "GROUP_LINKS", 0)
    (keys, often, group), _, _ = aligner.links(a, ga, b, gb, len(piece))
    assert one == {(k, g): n for k, n, g in zip(keys.tolist(), often.tolist(), group.tolist(), strict=True)}


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_perfect_hash_numbers_every_key_once(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    h = alignment.PerfectHash.from_bytes(alignment.PerfectHash.build(keys).to_bytes())
    assert h.size == n and sorted(h.numbers(keys).tolist()) == list(range(n))
    if n == 5000:
        assert sum(len(x) for x in h.levels) < n  # under a byte a key
        with pytest.raises(ValueError):
            alignment.PerfectHash.build(np.array([3, 3]))


def test_documents_that_change_between_the_passes_are_noticed():
    table = alignment.Table({s: (alignment.PerfectHash.build(np.array([5])), np.array([5]), np.array([1])) for s in range(alignment.SHARDS)}, np.ones(4, np.int64), 10)
    with pytest.raises(ValueError):
        table.counts(np.array([7]))
