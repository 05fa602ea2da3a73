"""Quality rules as weak supervision.

Rules look at independent properties of a document and vote (keep or drop) or abstain. Expectation-maximisation over the counts of
vote patterns (at most 3 ** rules rows, whatever the corpus) estimates how each rule votes on good and on bad
documents, and each pattern gets its posterior probability of good quality; that replaces all-must-pass filtering.

Rules overlap and err: each votes both ways on evidence of its own (words, symbols, lines, letters), so that a document
with one "drop" may be kept, and one without any dropped. overruled() counts such documents.

Defined results: a null text has no words. All rules abstain on documents without words. Equal statistics get equal
verdicts, repeated rows included. An empty table gives an empty result. Other columns stay away. Ids are whole numbers;
others are refused by the cast to long.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize, mix, slices, word_hashes

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bang", "n_ended", "n_plain", "n_distinct", "n_short", "entropy"]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _BANG = _class(b"#*$%&|<>"), _class(b"!?")
_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER | _class(bytes(range(97, 123)))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_INK = ~_class(b" \t\n\x0b\x0c\r")
#: What a sentence ends with, and what may follow it.
_ENDS, _AFTER = (b".", b"!", b"?", b":", "\u3002".encode(), "\u2026".encode()), b" \t\r\x0b\x0c\"')]"
_PLAIN = _LETTER | _class(bytes([*range(48, 58), *range(0x80, 0x100)]))
_POINT = ~_class(bytes(range(0x80, 0xC0))) & ~_class(b" \t\n\x0b\x0c\r")  # first bytes of code points inside words


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text of a run of texts.

    n_ended: lines that end like a sentence; n_plain: words with a letter or digit, n_distinct different
    ones of them, n_short those of three code points at most; entropy: of bytes outside of
    white space, A-Z as a-z, in thousandths of a bit.
    """
    n = len(offsets) - 1

    def total(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    words, bounds = word_hashes(data, offsets, lower=False)
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
        window = mix(mix(mix(words[:-2] + row[:-2]) + words[1:-1]) + words[2:])
        inside = row[:-2] == row[2:]
        _, back, counts = np.unique(window[inside], return_inverse=True, return_counts=True)
        first = np.flatnonzero(inside)[counts[back] > 1]
        for k in range(3):
            repeated[first + k] = True
    row = np.repeat(np.arange(n), np.diff(bounds))
    ink = _INK[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = ink[edges]
    starts = np.flatnonzero(start)
    long_, plain = (np.add.reduceat(m[data], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for m in (_POINT, _PLAIN))
    plain = plain > 0  # a separator or a bullet is no word of the vocabulary
    _, at = np.unique(mix(words + mix(row.astype(np.uint64)))[plain], return_index=True)
    distinct = np.bincount(row[plain][at], minlength=n)
    char = np.bincount(np.repeat(np.arange(n), np.diff(offsets))[ink] * 256 + _FOLD[data[ink]], minlength=256 * n).reshape(n, 256)
    share = char / np.maximum(char.sum(axis=1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    raw, lines, again, ended = data.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        full = [x for x in raw[a:b].split(b"\n") if x.strip()]
        lines[i], again[i], ended[i] = len(full), len(full) - len(set(full)), sum(x.rstrip(_AFTER).endswith(_ENDS) for x in full)
    return {
        "n_words": np.diff(bounds), "word_chars": total(_POINT[data], offsets), "n_symbols": total(_SYMBOLS[data], offsets), "n_lines": lines, "n_dup_lines": again,
        "n_repeat_words": total(repeated, bounds), "n_letters": total(_LETTER[data], offsets), "n_upper": total(_UPPER[data], offsets), "n_bang": total(_BANG[data], offsets),
        "n_ended": ended, "n_plain": total(plain, bounds), "n_distinct": distinct, "n_short": total(plain & (long_ <= 3), bounds), "entropy": np.floor(1000 * entropy).astype(np.int64),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch["text"]):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j].cast(pa.int64()), *(pa.array(found[x], pa.int64()) for x in STATISTICS)], ["doc_id", *STATISTICS])


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and STATISTICS for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _measure, "doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A named rule: when it votes to drop, when to keep; otherwise it abstains."""

    name: str
    drop: Column
    keep: Column


def default_rules() -> list[Rule]:
    """Rules over STATISTICS, each with a drop vote, a keep vote and a band between them in which it abstains."""
    c, some = F.col, F.col("n_words") > 0
    words, letters, lines, plain = c("n_words"), c("n_letters"), c("n_lines"), c("n_plain")

    def rule(name: str, drop: Column, keep: Column) -> Rule:
        return Rule(name, some & drop, some & keep)

    return [
        rule("word_length", ~c("word_chars").between(3 * words, 9 * words), c("word_chars").between(4 * words, 7 * words)),
        rule("symbols", 10 * c("n_symbols") > words, 50 * c("n_symbols") <= words),
        rule("repetition", (2 * c("n_dup_lines") > lines) | (100 * c("n_repeat_words") > 35 * words), (c("n_dup_lines") == 0) & (100 * c("n_repeat_words") <= 10 * words)),
        rule("shouting", (2 * c("n_upper") > letters) | (10 * c("n_bang") > words), (5 * c("n_upper") <= letters) & (20 * c("n_bang") <= words)),
        rule("line_ends", (lines >= 3) & (2 * c("n_ended") < lines), (lines >= 3) & (5 * c("n_ended") >= 4 * lines)),
        rule("variety", 4 * c("n_distinct") < plain, 5 * c("n_distinct") >= 3 * plain),
        rule("short_words", ~(100 * c("n_short")).between(10 * plain, 60 * plain), (100 * c("n_short")).between(20 * plain, 50 * plain)),
        rule("entropy", ~c("entropy").between(3000, 4800), c("entropy").between(3650, 4400)),
    ]


def votes(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the pattern of votes: a character for each rule, D, K or - in order."""
    vote = [F.when(F.coalesce(r.drop, F.lit(False)), "D").when(F.coalesce(r.keep, F.lit(False)), "K").otherwise("-") for r in rules]
    return stats.withColumn("votes", F.concat(*vote))


@dataclass
class LabelModel:
    """prior of good quality; rates[rule, class, vote] of votes D, K, - on bad (0) and good (1) documents."""

    prior: float
    rates: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of good quality of patterns, given as vote codes (pattern, rule)."""
        logs = np.log(self.rates)
        like = np.stack([sum(logs[j, y, codes[:, j]] for j in range(codes.shape[1])) for y in (0, 1)], 1) if codes.shape[1] else np.zeros((len(codes), 2))
        odds = np.log(self.prior) - np.log(1 - self.prior) + like[:, 1] - like[:, 0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def pattern_codes(patterns: list[str]) -> np.ndarray:
    width = len(patterns[0]) if patterns else 0
    return np.array([["DK-".index(x) for x in p] for p in patterns], np.int64).reshape(len(patterns), width)


#: What is thought of a rule before any data: votes D, K, - on bad and on good documents; and the share of all
#: documents that this counts as. It says that rules are better than chance, so that the classes keep their meaning.
PRIOR_RATES, PRIOR_SHARE = ((0.20, 0.05, 0.75), (0.01, 0.29, 0.70)), 0.05


def learn(patterns: dict[str, int], rounds: int = 20_000) -> LabelModel:
    """Expectation-maximisation over patterns and their counts, begun from "bad if any rule says drop".

    Rates are posterior means under PRIOR_RATES, whose weight grows with the corpus. A warning says so if `rounds` are
    over before the posteriors have settled.
    """
    order = sorted(patterns)
    codes, counts = pattern_codes(order), np.array([patterns[x] for x in order], float)
    n_rules = codes.shape[1]
    before = np.array(PRIOR_RATES)
    model = LabelModel(0.5, np.repeat(before[None], n_rules, 0))
    good = np.where((codes == 0).any(axis=1), 0.02, 0.98)
    for _ in range(rounds if len(order) else 0):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        rates, prior_share = np.empty((n_rules, 2, 3)), np.array([1 - prior, prior])
        for j in range(n_rules):
            for v in range(3):
                rates[j, :, v] = weight[:, codes[:, j] == v].sum(axis=1) + before[:, v] * (PRIOR_SHARE * counts.sum() * prior_share + 1)
        rates /= rates.sum(axis=2, keepdims=True)
        model = LabelModel(float(prior), rates)
        new = model.posterior(codes)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    else:
        if len(order):
            warnings.warn(f"posteriors have not settled after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return model


def assess(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, STATISTICS, votes, quality (posterior), base_failed, kept."""
    voted = materialize(votes(measure(docs, text, doc_id), rules or default_rules()), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # 3 ** rules at most
    model = learn(counts)
    patterns = sorted(counts)
    quality = model.posterior(pattern_codes(patterns)).tolist() if patterns else []
    table = docs.sparkSession.createDataFrame(list(zip(patterns, quality, strict=True)), "votes string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = voted.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def overruled(found: DataFrame) -> DataFrame:
    """Of the rows of assess() that pass the base: n_any_drop (a rule says drop), n_kept_despite and n_dropped_without."""
    some, kept = F.col("votes").contains("D"), F.col("kept")
    count = lambda test: F.count(F.when(test, 1))
    return found.filter(~F.col("base_failed")).agg(count(some).alias("n_any_drop"), count(some & kept).alias("n_kept_despite"), count(~some & ~kept).alias("n_dropped_without"))
