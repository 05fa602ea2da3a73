"""Toxicity by a weighted finite-state pattern grammar.

A lexer gives each word a symbol: insult, threat, target, negation, report, clause end, or other. Sequential transducers
rewrite the tape of symbols: one marks insults and threats that stand near a target, one those behind a negation, one
those inside of reported speech. They are composed into one transducer, which reads each clause that holds an insult or
threat; a clause's marked matches, weighted by their words, are summed up by kind of mark, and a logistic model of these
sums scores the document. A word alone scores nothing: what counts is the match that its clause gives it.

Words of insult and threat are the listed ones and stems learned from labels. A stem's weight is the log of how much
more often it is said in toxic training texts; contexts (the word with its neighbours) are counted once, so that copies
of one text don't make stems of its words. The model learns from a bounded sample of labelled rows (SAMPLE distinct
texts of each label, those of least digest); everything else covers all rows and whole texts.

Defined results: a null or empty text is scored like any text without matches. Rows without a label, or with a null one,
teach nothing; a document with several labels counts as toxic if one says so. Without labels of both kinds the listed
words score alone. Repeated rows get equal scores; an empty table gives an empty result. Other columns aren't touched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize

#: Distinct labelled texts of each label that are learned from at most; stems in the lexicon at most.
SAMPLE, STEMS = 6_000, 2_000
#: Letters of a stem at least and at most; contexts of a stem in toxic texts, its log ratio and its G statistic at least.
SHORTEST, LONGEST, LEAST_CONTEXTS, LEAST_WEIGHT, LEAST_G = 3, 9, 5, 1.5, 40.0
#: Contexts that a listed word counts as having in toxic texts, besides those seen, and its share of clean ones.
BELIEF, DOUBT = 4.0, 0.02

# Words of each symbol, in several languages.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "dumb", "retard", "bastard", "vermin", "filth", "pig"]
THREATS = ["kill", "hurt", "beat", "stab", "shoot", "burn", "destroy", "die", "töten", "umbringen", "tuer", "matar", "matarte"]
TARGETS = ["you", "your", "yours", "yourself", "u", "he", "she", "they", "them", "him", "her", "these", "those", "du", "dich", "dir", "ihr", "euch", "tu", "te", "toi", "vous", "ils", "tú", "usted", "ustedes", "ellos"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "nobody", "without", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "sans", "nunca", "sin", "jamás"]
REPORTS = ["said", "says", "say", "wrote", "called", "calls", "quoted", "claims", "claimed", "reported", "alleged", "according", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó"]

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]+")


# -- transducers -----------------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """A sequential weighted transducer: arcs[state, symbol] = (next state, symbol written, weight). Missing arcs stay
    in place and copy the symbol."""

    arcs: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def read(self, tape: list[str]) -> tuple[list[str], float]:
        state, out, weight = self.start, [], 0.0
        for symbol in tape:
            state, written, w = self.step(state, symbol)
            out.append(written)
            weight += w
        return out, weight


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that feeds what `first` writes to `second`; weights add up. Only states that can be reached."""
    out, todo, seen = Transducer(start=(first.start, second.start)), [(first.start, second.start)], set()
    while todo:
        a, b = state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        for symbol in symbols:
            a2, between, w1 = first.step(a, symbol)
            b2, written, w2 = second.step(b, between)
            out.arcs[state, symbol] = ((a2, b2), written, w1 + w2)
            todo.append((a2, b2))
    return out


HITS = ("insult", "threat")
MARKS = ("target", "negated", "reported")
SYMBOLS = [*HITS, "target", "negation", "report", "end", "other"]


def _written(hit: str, marks: tuple[str, ...]) -> str:
    return "+".join((hit, *marks))


def _forms(mark: str) -> list[str]:
    """What may stand on the tape for a hit before `mark` is written."""
    earlier = MARKS[: MARKS.index(mark)]
    return [_written(h, tuple(m for m, on in zip(earlier, chosen, strict=True) if on)) for h in HITS for chosen in product((0, 1), repeat=len(earlier))]


def within(trigger: str, window: int, mark: str, weight: float = 0.0) -> Transducer:
    """Marks hits that come at most `window` words behind the trigger, in the same clause (window 0: anywhere behind)."""
    t = Transducer()
    hits, plain = _forms(mark), [s for s in SYMBOLS if s not in (*HITS, trigger, "end")]
    for left in range(1, max(window, 1) + 1):
        after = left - 1 if window else left
        for s in plain:
            t.arcs[left, s] = (after, s, 0.0)
        for h in hits:
            t.arcs[left, h] = (after, f"{h}+{mark}", weight)
        t.arcs[left, "end"] = (0, "end", 0.0)
    for left in range(max(window, 1) + 1):
        t.arcs[left, trigger] = (max(window, 1), trigger, 0.0)
    return t


def grammar() -> Transducer:
    """Target, negation and reported speech, composed: a hit leaves it with all marks that its clause gives it."""
    targeted = compose(within("target", 4, "target"), within("negation", 3, "negated"), SYMBOLS)
    return compose(targeted, within("report", 0, "reported"), SYMBOLS)


#: What hits can be written as, and the kind of sum that each adds to.
KINDS = ["plain", "target", "negated", "reported"]


def kind(written: str) -> int | None:
    """Which sum a written symbol adds to: reported speech before negation, negation before target; None for no hit."""
    head, *marks = written.split("+")
    if head not in HITS:
        return None
    return 3 if "reported" in marks else 2 if "negated" in marks else 1 if "target" in marks else 0


# -- lexicon ---------------------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Weights of whole words and of stems, and the symbols of words that have none."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, float]
    symbols: dict[str, str]
    lengths: list[int]

    def look(self, word: str) -> tuple[str, float]:
        """(symbol, weight); the longest stem counts."""
        if word in self.words:
            return self.words[word]
        if word in self.symbols:
            return self.symbols[word], 0.0
        for n in self.lengths:
            if len(word) >= n and (weight := self.stems.get(word[:n])) is not None:
                return "insult", weight
        return "other", 0.0


def tokens(text: str) -> list[str]:
    """Words in lower case, and marks that end clauses as they stand."""
    return _TOKEN.findall(text.lower().replace("’", "'"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct (word, context) of a batch's texts, with the label; contexts are digests of the word with neighbours."""
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = [w for w in tokens(text or "") if w[0].isalpha()]
            found = {(words[i], " ".join(words[max(i - 1, 0) : i + 2])) for i in range(len(words))}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([c for _, c in found]), pa.array([toxic] * len(found), pa.int32())], ["word", "context", "toxic"])


def learn_words(sample: DataFrame) -> Lexicon:
    """Weights of the listed words and of significant stems, from the distinct contexts of sampled texts."""
    contexts = map_arrow(sample, _contexts, "word string, context string, toxic int").select("word", F.xxhash64("context").alias("context"), "toxic").distinct()
    counted = contexts.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counted = materialize(counted, "words")
    a_all, b_all = (x or 0 for x in counted.agg(F.sum("a"), F.sum("b")).first())
    listed = {w: "insult" for w in INSULTS} | {w: "threat" for w in THREATS}
    seen = {r["word"]: (r["a"], r["b"]) for r in counted.filter(F.col("word").isin(list(listed))).collect()}
    ratio = lambda a, b: math.log((a + 0.5) / (a_all + 1)) - math.log((b + 0.5) / (b_all + 1))
    words = {}
    for w, symbol in listed.items():
        a, b = seen.get(w, (0, 0))
        words[w] = (symbol, max(0.0, math.log((a + BELIEF) / (a_all + 1000)) - math.log((b + DOUBT * BELIEF) / (b_all + 1000))))
    symbols = {w: s for s, some in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in some}
    stems: dict[str, float] = {}
    if a_all and b_all:
        n = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))))
        of = counted.filter((F.length("word") >= SHORTEST) & ~F.col("word").isin([*listed, *symbols])).withColumn("n", n)
        of = of.groupBy(F.col("word").substr(F.lit(1), F.col("n")).alias("stem")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= LEAST_CONTEXTS)
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        share = (a + b) / (a_all + b_all)
        part = lambda x, total: F.when(x > 0, x * F.log(x / (share * total))).otherwise(0.0)
        g = 2 * (part(a, a_all) + part(b, b_all))
        weight = F.log((a + 0.5) / (a_all + 1)) - F.log((b + 0.5) / (b_all + 1))
        best = of.withColumns({"g": g, "weight": weight}).filter((F.col("g") >= LEAST_G) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("g"), F.length("stem"), "stem").limit(10 * STEMS).collect()
        for r in best:
            stem = r["stem"]
            related = any(stem[:k] in stems for k in range(SHORTEST, len(stem))) or any(s.startswith(stem) for s in stems)
            if not related and len(stems) < STEMS:
                stems[stem] = ratio(r["a"], r["b"])
    return Lexicon(words, stems, symbols, sorted({len(s) for s in stems}, reverse=True))


# -- scoring ---------------------------------------------------------------------------------------------------

#: What a document's clauses come to: the sum of each kind, the heaviest clause, sums per 100 words, and length.
FEATURES = [*KINDS, "heaviest", "density", "length"]


class Reader:
    """The composed grammar over texts, with a memory of words that is bounded."""

    def __init__(self, lexicon: Lexicon, memory: int = 200_000):
        self.lexicon, self.memory, self.known = lexicon, memory, {}
        composed, states = grammar(), {}
        index = lambda s: states.setdefault(s, len(states))
        index(composed.start)
        self.arcs = {(index(q), s): (index(to), kind(written)) for (q, s), (to, written, _) in composed.arcs.items()}

    def look(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            found = self.known[word] = self.lexicon.look(word) if word[0].isalpha() else ("end", 0.0)
        return found

    def clause(self, words: list[tuple[str, float]], sums: list[float]) -> float:
        """Add a clause's matches to the sums by kind; returns its weight."""
        state, total = 0, 0.0
        for symbol, weight in words:
            state, sort = self.arcs[state, symbol]
            if sort is not None:
                sums[sort] += weight
                total += weight
        return total

    def features(self, text: str) -> list[float]:
        sums, heaviest, n_words, begin = [0.0] * len(KINDS), 0.0, 0, 0
        read = [self.look(w) for w in tokens(text)]
        hits = [i for i, (s, _) in enumerate(read) if s in HITS]
        n_words = sum(s != "end" for s, _ in read)
        at = 0
        while at < len(hits):
            begin = end = hits[at]
            while begin > 0 and read[begin - 1][0] != "end":
                begin -= 1
            while end < len(read) and read[end][0] != "end":
                end += 1
            heaviest = max(heaviest, self.clause(read[begin:end], sums))
            while at < len(hits) and hits[at] < end:
                at += 1
        total = sum(sums)
        return [*(math.log1p(x) for x in sums), math.log1p(heaviest), math.log1p(100 * total / (n_words + 10)), math.log1p(n_words)]


def _read(lexicon: Lexicon, extra: list[str], weights: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            rows = np.array([reader.features(t or "") for t in batch["text"].to_pylist()], float).reshape(-1, len(FEATURES))
            keep = [batch[c] for c in extra]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x) for x in rows.T.copy())], [*extra, *FEATURES])
            else:
                yield pa.RecordBatch.from_arrays([*keep, pa.array(predict(rows, weights))], [*extra, "score"])

    return run


def predict(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design(rows) @ weights, -30, 30)))


def design(rows: np.ndarray) -> np.ndarray:
    """Features, what density and length do together, and a constant."""
    return np.column_stack([rows, rows[:, 5] * rows[:, 6], np.ones(len(rows))])


#: What each column of design() weighs before any label, and how strongly that is believed.
BEFORE = np.array([0.5, 0.7, 0.2, 0.2, 0.5, 0.3, 0.0, 0.0, -2.5])
TRUST = np.array([0.3] * 8 + [0.01])


def fit_weights(rows: np.ndarray, toxic: np.ndarray, worth: tuple[float, float] = (1.0, 1.0), rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a normal prior around BEFORE, each step halved until it helps.

    worth: how many texts each sampled one of a label stands for.
    """
    x, y, w = design(rows), toxic.astype(float), BEFORE.copy()
    each = np.where(y > 0, worth[1], worth[0]) * len(y) / np.where(y > 0, worth[1], worth[0]).sum()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(each * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(TRUST * (w - BEFORE) ** 2))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + TRUST * (w - BEFORE)
        step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + np.diag(TRUST), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            return w
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def sample_labelled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, tuple[float, float]]:
    """(text, toxic) of at most `size` distinct texts of each label: those of least digest; all, if there are fewer.
    Also how many texts of its label each of them stands for.

    Only digests are sorted, and one digest for each label goes through the driver.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    digest = F.substring(F.sha2("text", 256), 1, 32)
    texts = docs.filter(F.col("text").isNotNull())
    rows = texts.select("doc_id", digest.alias("digest")).join(marked, "doc_id").select("digest", "toxic")
    keys = materialize(rows.groupBy("digest").agg(F.max("toxic").alias("toxic")), "digests")
    bounds = [keys.filter(F.col("toxic") == k).orderBy("digest").limit(size).agg(F.max("digest")).first()[0] or "" for k in (0, 1)]
    counts = {r["toxic"]: r["count"] for r in keys.groupBy("toxic").count().collect()}
    most = F.when(F.col("toxic") == 1, bounds[1]).otherwise(bounds[0])
    chosen = keys.filter(F.col("digest") <= most)
    # No text is shuffled but those of the sample.
    few = texts.select("text", digest.alias("digest")).filter(F.col("digest") <= max(bounds)).join(F.broadcast(chosen), "digest")  # 2 * size digests at most
    sample = few.groupBy("digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    return materialize(sample, "sample"), tuple(max(1.0, counts.get(k, 0) / size) for k in (0, 1))


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Words, stems and weights from the labelled rows among docs (doc_id, text)."""
    sample, worth = sample_labelled(docs, labels, size)
    lexicon = learn_words(sample)
    found = map_arrow(sample, _read(lexicon, ["toxic"], None), "toxic int, " + ", ".join(f"{x} double" for x in FEATURES)).toArrow()  # 2 * size rows at most
    toxic, rows = found["toxic"].to_numpy(), np.column_stack([found[x].to_numpy() for x in FEATURES])
    return Model(lexicon, fit_weights(rows, toxic, worth) if len(set(toxic.tolist())) == 2 else BEFORE)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _read(model.lexicon, ["doc_id"], model.weights), "doc_id long, score double")
