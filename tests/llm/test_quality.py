"""Kneser-Ney against a plain version; thresholds, filters and edge cases."""

import math
from collections import Counter, defaultdict

import pytest

from paytrail.llm import kneser_ney as kn

TRAIN = ["a b c a b d", "a b c", "b c d a b", "x y z x y", "the cat sat on the mat", "the cat ate", "the dog sat on the cat", "a a a a b"]


def brute(train, order):
    """p(word | context words) of interpolated modified Kneser-Ney, with start marks."""
    raw = Counter()
    for t in train:
        w = ["<s>"] * (order - 1) + t.split()
        raw.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    counts = {order: raw}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d, total, mass = {}, defaultdict(dict), defaultdict(dict)
    for n, c in counts.items():
        few = Counter(c.values())
        n1, n2, n3, n4 = (few[i] for i in (1, 2, 3, 4))
        d[n] = kn.discounts(n1, n2, n3, n4)
        for g, k in c.items():
            total[n][g[:-1]] = total[n].get(g[:-1], 0) + k
            mass[n][g[:-1]] = mass[n].get(g[:-1], 0) + d[n][min(k, 3) - 1]
    vocabulary = len(counts[1]) + 1

    def p(gram):
        out = 1 / vocabulary
        for n in range(1, order + 1):
            g = gram[-n:]
            if g[:-1] in total[n]:
                k = counts[n].get(g, 0)
                out = ((k - d[n][min(k, 3) - 1]) if k else 0) / total[n][g[:-1]] + mass[n][g[:-1]] / total[n][g[:-1]] * out
        return out

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_log_probabilities_equal_the_plain_model(spark, order):
    df = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    tables = kn.Tables.collect(order, *kn.train_tables(df, order))
    p, texts = brute(TRAIN, order), [*TRAIN, "a b q", "unknown words only", "", None]
    n, s = tables.log_probs(texts, kn.WordHash())
    for t, words, got in zip(texts, n, s, strict=True):
        w = ["<s>"] * (order - 1) + (t or "").split()
        want = sum(math.log(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w)))
        assert words == len((t or "").split()) and got == pytest.approx(want, abs=1e-4)


def test_discounts_stay_inside_their_counts():
    assert kn.discounts(0, 0, 0, 0) == [0.5, 1.0, 1.5]
    assert kn.discounts(100, 5, 1, 90) == pytest.approx([1 - 2 * (100 / 110) * 0.05, 2 - 3 * (100 / 110) * 0.2, 1.5])
    y = 100 / 180
    assert kn.discounts(100, 40, 20, 10) == pytest.approx([1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])


def test_copies_in_the_training_text_leave_unseen_words_a_chance(spark):
    df = spark.createDataFrame([(t,) for t in ["a b c d"] * 4 + ["e f g h"] * 4 + ["i j k"] * 3], "text string")
    tables = kn.Tables.collect(3, *kn.train_tables(df, 3))
    _, s = tables.log_probs(["a b zz", "zz zz"], kn.WordHash())
    assert all(math.isfinite(x) for x in s)


def rows():
    good = [(i, " ".join(f"w{(i * 7 + j * 3) % 23}" for j in range(30)), "en" if i % 3 else "de", 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"zz{i}{j}$$$" for j in range(30)), "en", 0) for i in range(8)]
    return good + bad


def test_thresholds_keep_clean_rows_and_reject_junk(spark):
    data = rows() + [(2000, "", "en", None), (2001, None, None, None), (2002, "w1 w4 w7", None, 1), (2002, "w1 w4 w7", None, 1)]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang, _ in data], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in data] + [(None, 1)], "doc_id long, quality int")
    got = kn.classify(docs, labels, order=2).collect()
    assert len(got) == len(data)
    keep = {r.doc_id: r.keep for r in got}
    assert not any(keep[1000 + i] for i in range(8))
    assert sum(keep[i] for i in range(300)) >= 285 and keep[2000] and keep[2001]
    assert [r.perplexity for r in got if r.doc_id in (2000, 2001)] == [None, None]
    model, _ = kn.fit(docs, labels, order=2)
    left = kn.without_low_quality(docs, model)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.keep)
    once = kn.good_rows(docs.withColumnRenamed("n_words", "__words"), labels, order=2)
    assert once.columns == ["doc_id", "text", "lang", "__words"]
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in got if r.keep)


def scored_rows(n, lang, scale=1.0):
    """Rows of ten words whose mean negative log probability goes evenly from 5 to 5 + scale."""
    return [(f"{lang}{i}", lang, 10, -10 * (5 + scale * i / n)) for i in range(n)]


def test_one_rule_at_every_size(spark):
    """A language's limit moves evenly from that of all languages to its own as its rows grow; no size changes the rule."""
    def limits(n):
        data = scored_rows(n, "aa", 3.0) + scored_rows(4000, "bb")
        scored = spark.createDataFrame(data, "id string, lang string, n_words long, log_prob double")
        labels = spark.createDataFrame([(r[0], 1) for r in data], "doc_id string, quality int")
        return kn.thresholds(scored, labels)
    sizes = (150, 198, 202, 400, 2000)
    got = [limits(n) for n in sizes]
    over = [x["aa"][1] - x["aa"][0] for x in got]
    assert over == sorted(over) and over[2] - over[1] < 0.1  # no jump where a quantile becomes resolvable
    assert all((x[kn.ALL][1] - x[kn.ALL][0]) < (x["aa"][1] - x["aa"][0]) for x in got)
    model = kn.Classifier(None, got[0])
    assert model.rate("unseen", 10, -50.0)[1] == got[0][kn.ALL][1] and model.rate("*", 10, -50.0)[1] == got[0][kn.ALL][1]
    assert kn.Classifier(None, {}).rate("aa", 10, -50.0) is None


def test_without_trusted_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert [r.keep for r in kn.classify(docs, labels).collect()] == [True]
    assert kn.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_every_trusted_row_outside_the_fold_is_counted(spark):
    """No bound on the training text: 2600 texts of words of their own, some equal, rows in many small blocks."""
    data = [(i, f"a{i % 2500} b{i % 2500} a{i % 2500}", "en") for i in range(2600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in data], "doc_id long, quality int")
    inside = {r.id for r in kn.trusted_labels(labels, "doc_id").filter("fold <> 0").collect()}
    texts = {t for i, t, _ in data if i in inside}
    assert len(texts) > 2000
    model = kn.train(docs, labels, order=2)
    assert model.vocabulary == len({w for t in texts for w in t.split()}) + 1


def test_blocks_and_lots_do_not_change_the_scores(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*TRAIN, *TRAIN[:3], "a b q", "zz", "", None])], "doc_id long, text string, lang string").repartition(3)
    texts = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(2)
    model = kn.train_model(texts, 3, block_words=7, shards=5)
    got = {r.id: (r.n_words, r.log_prob) for r in kn.perplexities(docs, model, lots=2, block_words=9).collect()}
    p = brute(TRAIN, 3)
    assert len(got) == docs.count()
    for i, t, _ in docs.collect():
        w = ["<s>"] * 2 + (t or "").split()
        want = sum(math.log(p(tuple(w[j - 2 : j + 1]))) for j in range(2, len(w)))
        assert got[i] == (len(w) - 2, pytest.approx(want, abs=1e-4))


def test_training_keeps_the_model_alone_and_shuffles_no_words(spark):
    """The words of a block are a file that every level reads; when the model is whole, only its own files are left."""
    import os

    from paytrail.session import checkpoint_root

    root = checkpoint_root(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root))
    model = kn.train_model(spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3), 3, block_words=7, shards=2)
    left = {x for x in set(os.listdir(root)) - before if x.startswith("kn-")}
    assert left == {os.path.basename(model.root)}
