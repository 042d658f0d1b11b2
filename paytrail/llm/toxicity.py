"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers run over a clause's words, each reading the labels the one
before it wrote; they are composed into one machine before any text is read:

* lexicon: words to the labels INSULT, THREAT, TARGET, NEGATION, REPORT or OTHER;
* negation: an insult or threat within ``NEGATION_SCOPE`` words after a negation is marked NEG;
* reported speech: one after a reporting verb in the same clause is marked REP;
* target: one within ``TARGET_SCOPE`` words of an address ("you ...", "... you") is marked TGT.

A match that is negated or reported counts as that, whatever it is aimed at.

A clause's arcs carry the lexicon's weights; a document's features are the
weight sums of the clauses by final mark, not counts of isolated words.  A logistic
layer with prior weights turns them into a score between 0 and 1.

The insult and threat stems are learned from labelled rows: words and word beginnings that are
significantly more frequent in toxic texts.  Training reads at most ``max_toxic``
and ``max_clean`` labelled rows (the documented bound of the fit), chosen by a
hash of the document id, without near copies of one another.  Language, source,
id and labels are no inputs of a score.

Defined results: a null or empty text scores as a text without matches; rows with
null or conflicting labels are not trained on; without any toxic label the model has the fixed
function words only; repeated rows are each scored; an empty table gives an empty
result; other columns are not read.  Whole texts are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.common import Shared, pick, small_batches, stored

MAX_TOXIC, MAX_CLEAN = 3000, 9000
NEGATION_SCOPE, TARGET_SCOPE = 3, 3
MIN_STEM, MAX_STEM = 4, 12
PURITY = 0.8  # share of toxic rows among the rows with a stem
MIN_WEIGHT = 1.0

# fixed function words of the grammar, by label; languages: English, German, French, Spanish
FUNCTION_WORDS = {
    "TARGET": "you your yours yourself du dich dir dein deine ihr euch tu toi ton ta vous votre tú tuyo usted ustedes",
    "NEGATION": "not never no without nicht kein keine nie niemals ne pas jamais sans nunca jamás ni sin",
    "REPORT": "said says say told claimed wrote quoted reported sagte sagt meinte schrieb dit dirent écrit dijo dice escribió",
}
# fixed threat verbs; they count only next to a target
THREAT_WORDS = "kill hurt destroy murder stab töten umbringen schlagen tuer frapper matar golpear destruir"

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
MARKS = ("", "NEG", "REP", "TGT")

# final features, with the prior means of their logistic weights
FEATURES = {"INSULT": 3.0, "INSULT+TGT": 4.0, "INSULT+NEG": 1.0, "INSULT+REP": 1.0, "THREAT": 0.5, "THREAT+TGT": 4.0,
            "THREAT+NEG": 0.2, "THREAT+REP": 0.2, "DENSITY": 1.0}
PRIOR_BIAS, RIDGE = -3.0, 0.5


@dataclass(frozen=True)
class Transducer:
    """Deterministic letter transducer: ``step(state, label) -> (state, label)``; state 0 starts a clause."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, label: str) -> tuple[int, str]:
        base, _, marks = label.partition("+")
        to, mark = self.arcs.get((state, base), self.arcs[(state, "*")])
        return to, f"{base}+{'+'.join(x for x in (marks, mark) if x)}" if marks or mark else base


def scoped(trigger: str, scope: int | None, mark: str, also_after: bool = False) -> Transducer:
    """Marks INSULT and THREAT within ``scope`` words after ``trigger`` (None: to the clause's end).

    ``also_after``: states past the scope remember a match, so that a trigger up to ``scope`` words behind it
    writes the label LATE, which moves the match's mark.
    """
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    last = scope or 1
    # state 0: nothing seen; 1..last: words left in the scope; last+1..2*last: words left in which a trigger still counts
    for s in range(0, 2 * last + 1 if also_after else last + 1):
        inside = 1 <= s <= last
        down = 0 if s == 0 or s == last + 1 else s - 1
        if scope is None and inside:
            down = s
        arcs[(s, "*")] = (down, "")
        arcs[(s, trigger)] = (last, "LATE" if s > last else "")
        for hit in ("INSULT", "THREAT"):
            arcs[(s, hit)] = (2 * last if also_after and not inside else down, mark if inside else "")
    return Transducer(2 * last + 1 if also_after else last + 1, arcs)


def compose(machines: list[Transducer], labels: list[str]) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The product machine's reachable arcs: each machine reads what the one before it wrote."""
    arcs, todo = {}, [tuple(0 for _ in machines)]
    seen = set(todo)
    while todo:
        state = todo.pop()
        for label in labels:
            out, to = label, []
            for machine, s in zip(machines, state, strict=True):
                s2, out = machine.step(s, out)
                to.append(s2)
            arcs[(state, label)] = (tuple(to), out)
            if tuple(to) not in seen:
                seen.add(tuple(to))
                todo.append(tuple(to))
    return arcs


LABELS = ["INSULT", "THREAT", "TARGET", "NEGATION", "REPORT", "OTHER"]
START = (0, 0, 0)


@dataclass
class Grammar:
    """The composed machine with its lexicon: ``stems`` (word beginnings; a trailing $ means the whole word) to weights."""

    stems: dict[str, float]
    weights: dict[str, float] = field(default_factory=lambda: dict(FEATURES))
    bias: float = PRIOR_BIAS

    def __post_init__(self):
        machines = [scoped("NEGATION", NEGATION_SCOPE, "NEG"), scoped("REPORT", None, "REP"), scoped("TARGET", TARGET_SCOPE, "TGT", also_after=True)]
        self.arcs = compose(machines, LABELS)
        self.words = {w: label for label, text in FUNCTION_WORDS.items() for w in text.split()}
        self.threats = set(THREAT_WORDS.split())
        self.lengths = sorted({len(s) for s in self.stems if s[-1] != "$"})
        # any stem or threat at a word's start: without it no clause can match
        heads = sorted({s.rstrip("$") for s in self.stems} | self.threats)
        self.any = re.compile(r"(?<![^\W\d_])(?:" + _alternatives(heads) + ")") if heads else None

    def label(self, word: str) -> tuple[str, float]:
        if (w := self.stems.get(word + "$")) is not None:
            return "INSULT", w
        for n in self.lengths:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                return "INSULT", w
        if word in self.threats:
            return "THREAT", 1.0
        return self.words.get(word, "OTHER"), 0.0

    def features(self, text: str | None) -> dict[str, float]:
        low = (text or "").lower()
        if self.any is None or not self.any.search(low):
            return {}
        out: dict[str, float] = {}
        matched = 0
        for clause in CLAUSE.split(low):
            if not self.any.search(clause):
                continue
            state, late = START, None
            for word in WORD.findall(clause):
                label, weight = self.label(word)
                state, mark = self.arcs[(state, label)]
                if label in ("INSULT", "THREAT"):
                    kind = next((f"{label}+{m}" for m in ("NEG", "REP", "TGT") if m in mark and f"{label}+{m}" in FEATURES), label)
                    out[kind] = out.get(kind, 0.0) + weight
                    matched += 1
                    late = (label, weight) if kind == label else None
                elif "LATE" in mark and late:
                    kind, weight = late
                    out[kind] -= weight
                    out[f"{kind}+TGT"] = out.get(f"{kind}+TGT", 0.0) + weight
                    late = None
        if matched:
            out["DENSITY"] = 100.0 * matched / max(20, len(WORD.findall(low)))
        return {k: math.log1p(v) for k, v in out.items() if v > 0}

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[k] * v for k, v in self.features(text).items())
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _alternatives(words: list[str]) -> str:
    """A trie written as a regular expression: alternatives that share a beginning share its test."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        if "" in node:
            return ""  # a shorter head suffices
        parts = [re.escape(c) + text(rest) for c, rest in node.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return text(trie)


# ---- learning -------------------------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_toxic: int, max_clean: int, hold_out: int = 5) -> DataFrame:
    """(id, text, toxic): the bounded sample.  Held-out rows (crc32 of the id as text mod ``hold_out`` = 0) never enter."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % hold_out != 0
    known = (labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").filter(fold))
    order = [F.xxhash64(F.lit("sample"), "id"), F.col("id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(known.filter("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean rows of two numbers: the proven bound of this broadcast
    return pick(docs, id_col, text_col).join(F.broadcast(chosen.select("id", "toxic")), "id")


def _sketch(words: list[str]) -> list[int]:
    """Three minima over word pairs: near copies share at least one almost surely."""
    pairs = {xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)} or {xxhash.xxh3_64_intdigest(" ".join(words))}
    return [min((p * m + 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF for p in pairs) for m in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Weighted word beginnings and whole words that mark toxic texts, from the bounded sample.

    Document frequencies are counted by Spark; the driver gets the stems that pass
    the test of significance.  Of a chain of beginnings the longest with (almost) the same rows is kept.
    """

    def words(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = WORD.findall((text or "").lower())
                stems = {w[:n] for w in set(found) for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} | {w + "$" for w in set(found) if len(w) >= MIN_STEM - 1}
                out.extend((s, toxic, 1 - toxic) for s in stems)
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], ["stem", "a", "c"])

    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    nt, nc = totals.get(1, 0), totals.get(0, 0)
    if not nt or not nc:
        return {}
    p0 = nt / (nt + nc)
    counts = sample.select("text", "toxic").mapInArrow(words, "stem string, a int, c int").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    share = F.col("a") / (F.col("a") + F.col("c"))
    gain = F.col("a") * F.log(share / p0) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - p0))).otherwise(0.0)
    # log-likelihood gain against the hypothesis "as toxic as any text", for about a million candidates
    found = {s: (a, c) for s, a, c in counts.filter((F.col("a") >= 3) & (share >= PURITY)).filter(gain >= math.log(1e6) + 2.0).select("stem", "a", "c").collect()}
    kept: dict[str, float] = {}
    children: dict[str, int] = {}
    for s, (a, _) in found.items():
        children[s[:-1]] = max(children.get(s[:-1], 0), a)
    for s in sorted(found, key=lambda s: (len(s.rstrip("$")), s)):
        a, c = found[s]
        if s[-1] != "$" and children.get(s, 0) >= 0.9 * a:
            continue  # a longer one has nearly the same rows
        if any(s[:n] in kept for n in range(MIN_STEM, len(s))):
            continue  # a shorter one covers it
        kept[s] = max(MIN_WEIGHT, min(6.0, math.log((a + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))) / 3.0)
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Ridge logistic regression towards the prior (column 0 is the bias), by Newton steps."""
    w = prior.copy()
    penalty = np.full(len(w), RIDGE)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + penalty * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Grammar:
    small_batches(docs.sparkSession)
    # the documents are read once: everything below reads the bounded sample
    sample = stored(training_rows(docs, labels, id_col, text_col, max_toxic, max_clean), "toxic-sample")

    def sketches(batches):
        for batch in batches:
            keys = [_sketch(WORD.findall((t or "").lower())) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64())], ["id", "a", "b", "c"])

    kind = sample.schema["id"].dataType.simpleString()
    seen: tuple[set, set, set] = (set(), set(), set())
    single = []
    for row in sample.select("id", "text").mapInArrow(sketches, f"id {kind}, a long, b long, c long").orderBy("id").collect():
        if not any(k in s for k, s in zip(row[1:], seen, strict=True)):
            single.append((row[0],))
        for k, s in zip(row[1:], seen, strict=True):
            s.add(k)
    spark = docs.sparkSession
    sample = stored(sample.join(F.broadcast(spark.createDataFrame(single, f"id {kind}")), "id").dropDuplicates(["id"]), "toxic-sample")
    grammar = Grammar(learn_stems(sample))
    names = list(FEATURES)
    token = _share(spark, grammar)

    def vectors(batches):
        for batch in batches:
            own = token.get()
            out = []
            for text in batch.column(0).to_pylist():
                f = own.features(text)
                out.append([f.get(k, 0.0) for k in names])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.select("text", "toxic").mapInArrow(vectors, "toxic int, x array<double>").collect()
    if any(r[0] for r in rows) and not all(r[0] for r in rows):
        # sorted, so that the fit does not depend on the order in which tasks end
        data = np.array(sorted([float(r[0]), 1.0, *r[1]] for r in rows))
        w = fit_logistic(data[:, 1:], data[:, 0], np.array([PRIOR_BIAS, *FEATURES.values()]))
        grammar.bias, grammar.weights = float(w[0]), dict(zip(names, map(float, w[1:]), strict=True))
    return grammar


def _share(spark, grammar: Grammar) -> Shared:
    """A grammar broadcast once (its size is bounded by the sample) and built once per worker."""
    return Shared(spark, (grammar.stems, grammar.weights, grammar.bias), lambda parts: Grammar(*parts))


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, row by row."""
    small_batches(docs.sparkSession)
    src, held = pick(docs, id_col, text_col), _share(docs.sparkSession, grammar)

    def run(batches):
        for batch in batches:
            own = held.get()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with all columns, without the rows that score ``threshold`` or more."""
    small_batches(docs.sparkSession)
    held, k = _share(docs.sparkSession, grammar), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            own = held.get()
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(k).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
