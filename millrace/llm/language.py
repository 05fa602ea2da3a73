"""Language identification as mixture inference.

Each document is a mixture of languages: its character n-grams are drawn from the languages' n-gram models with the
document's proportions. Expectation-maximisation estimates the proportions, and the language set is the one with the
best likelihood less half of log(number of n-grams) for each language beyond the first.

The models are n-gram counts of all labelled rows, hashed into a fixed number of places, so that a model's size is
languages x places whatever the corpus. Counting combines in each task before the shuffle.

Defined results: texts that are null or have no letter get `und` with score 0. Ties go to the language that is first
by code point. Without any labelled text everything is `und`. Repeated rows are rows of their own; an empty table
gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, map_arrow, mix, ship, slices, texts

#: Places of the hashed n-gram table; n-gram length in characters; EM rounds at a time; added count for unseen n-grams.
PLACES, LENGTH, ROUNDS, SMOOTH = 1 << 15, 3, 12, 0.1
#: Characters of which n-grams are made at a time, so that scratch memory stays bounded for any text.
PIECE = 1 << 18
#: A likelihood has settled if it is less than this below its maximum; how often ROUNDS are repeated at most until then.
SETTLED, MOST_TIMES = 0.01, 500
#: Languages of a model at most: the driver and each worker hold PLACES numbers for each (some 65 MB at this bound).
MOST_LANGUAGES = 250

def _letter_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 else c
    return table


_TABLES: dict[str, np.ndarray] = {}


def grams(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of every n-gram of the texts that holds a letter, PIECE characters at a time.

    Words are separated by one blank or more.
    """
    raw = data.tobytes()
    if "letters" not in _TABLES:
        _TABLES["letters"] = _letter_table()
    parts = [(b" " + raw[a:b] + b" ").decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    points = _TABLES["letters"][np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
    blank = points == 32
    solid = ~(blank & np.concatenate([[False], blank[:-1]]))  # a run of blanks counts as one
    solid[starts] = True
    begins = np.searchsorted(np.flatnonzero(solid), starts)
    points = points[solid]
    for at in range(0, len(points) - length + 1, PIECE):
        piece = points[at : at + PIECE + length - 1].astype(np.uint64)
        n = len(piece) - length + 1
        row = np.searchsorted(begins, np.arange(at, at + len(piece)), "right").astype(np.int32) - 1
        value, ink = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(length):
            value = value * np.uint64(0x110000) + piece[k : k + n]
            ink |= piece[k : k + n] != 32
        ink &= row[:n] == row[length - 1 :]
        yield row[:n][ink], (mix(value[ink]) % np.uint64(places)).astype(np.int64)


@dataclass
class Model:
    """Languages in order of code points, and log probabilities (place, language)."""

    langs: list[str]
    logs: np.ndarray


def _count(length: int, places: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for i, j, data, offsets in slices(batch["text"]):
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                for row, place in grams(data, offsets, length, places):
                    counts = np.bincount(code[row] * places + place, minlength=len(names) * places)
                    for k, name in enumerate(names.tolist()):
                        sums[name] = sums.get(name, 0) + counts[k * places : (k + 1) * places]
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "place", "n"])

    return run


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH, places: int = PLACES, most: int = MOST_LANGUAGES) -> Model:
    """Count the n-grams of all rows whose language is not null. The driver gets `places` numbers for a language.

    Labels are counted first, by a scan of that column alone: more than `most` different ones raise a ValueError.
    """
    if labelled.filter(F.col(lang).isNotNull()).select(lang).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} different languages")
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = map_arrow(rows, _count(length, places), "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    langs = sorted(set(table["lang"].to_pylist()), key=lambda x: x.encode())
    counts = np.zeros((places, len(langs)))
    if langs:
        index = {x: k for k, x in enumerate(langs)}
        counts[table["place"].to_numpy(), [index[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    counts += SMOOTH
    return Model(langs, np.log(counts / counts.sum(axis=0)))


def _climb(p: np.ndarray, count: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some rounds of EM: shares, log likelihoods, and by how much these are below the maximum at most."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(count))))
    total = np.add.reduceat(count, starts)
    for k in range(rounds + 1):
        mixed = np.maximum(np.einsum("ij,ij->i", p, share[owner]), 1e-300)
        gain = np.add.reduceat(p * (count / mixed)[:, None], starts) / total[:, None]
        if k < rounds:
            share = share * gain
    # By Jensen's inequality no shares have a likelihood above this one by more than total * log(the largest gain).
    return share, np.add.reduceat(count * np.log(mixed), starts), total * np.log(np.maximum(gain.max(axis=1), 1))


def _pick(p: np.ndarray, count: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, count and starts of the chosen documents only."""
    size = np.diff(np.append(starts, len(count)))
    rows = np.repeat(chosen, size)
    return p[rows], count[rows], np.cumsum(size[chosen]) - size[chosen]


def proportions(p: np.ndarray, count: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once, until likelihoods settle: shares (document, language) and log likelihoods.

    p: probabilities (n-gram of a document, language); count: how often it occurs; starts: documents' first n-grams.
    """
    share, like, left = np.full((len(starts), p.shape[1]), 1 / p.shape[1]), np.zeros(len(starts)), np.arange(len(starts))
    for _ in range(MOST_TIMES):
        share[left], like[left], gap = _climb(p, count, starts, share[left], rounds)
        open_ = gap > SETTLED
        if not open_.any():
            break
        (p, count, starts), left = _pick(p, count, starts, open_), left[open_]
    return share, like


def choose(p: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """The language set of one document by penalised likelihood, languages leaving one by one, and its shares."""
    total, zero = count.sum(), np.zeros(1, np.int64)
    score = lambda s: (lambda share, like: (like[0] - 0.5 * np.log(total) * (len(s) - 1), share[0]))(*proportions(p[:, s], count, zero, rounds))
    kept = list(range(p.shape[1]))
    value, share = score(kept)
    best = value, kept, share
    while len(kept) > 1:
        kept = [k for i, k in enumerate(kept) if i != int(np.argmin(share))]
        value, share = score(kept)
        if value >= best[0]:
            best = value, kept, share
    likes = count @ np.log(p)  # every single language is a candidate as well
    if (single := likes.max()) >= best[0]:
        best = single, [int(np.argmax(likes))], np.ones(1)
    return best[1], best[2]


def _single(p: np.ndarray, count: np.ndarray, starts: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Documents whose best single language no set can beat: no set's likelihood exceeds the maximum over all languages."""
    sure, left, share = np.zeros(len(starts), bool), np.arange(len(starts)), np.full((len(starts), p.shape[1]), 1 / p.shape[1])
    for _ in range(MOST_TIMES):
        share, like, gap = _climb(p, count, starts, share, ROUNDS)
        least = single[left] + 0.5 * np.log(np.add.reduceat(count, starts))
        sure[left] = least >= like + gap
        open_ = (least < like + gap) & (least >= like) & (gap > SETTLED)
        if not open_.any():
            break
        (p, count, starts), left, share = _pick(p, count, starts, open_), left[open_], share[open_]
    return sure


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, its share, the set, its shares) for each text."""
    places, n = model.logs.shape[0], len(offsets) - 1
    out: list = [("und", 0.0, [], [])] * n
    found = [np.unique(row.astype(np.int64) * places + place, return_counts=True) for row, place in grams(data, offsets, length, places)]
    if not any(len(x) for x, _ in found) or not model.langs:
        return out
    code, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    count = np.bincount(back, np.concatenate([x for _, x in found]))
    row, place = code // places, code % places
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    docs = row[starts]
    logs = model.logs[place]
    single = np.add.reduceat(count[:, None] * logs, starts)
    p = np.exp(logs)
    ends = np.append(starts[1:], len(row))
    sure = _single(p, count, starts, single.max(axis=1))
    for k, doc in enumerate(docs.tolist()):
        if sure[k]:
            top = int(np.argmax(single[k]))
            out[doc] = (model.langs[top], 1.0, [model.langs[top]], [1.0])
        else:
            kept, share = choose(p[starts[k] : ends[k]], count[starts[k] : ends[k]])
            out[doc] = (model.langs[kept[int(np.argmax(share))]], min(1.0, float(share.max())), [model.langs[i] for i in kept], share.tolist())
    return out


def _predict(shared: object, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, offsets in slices(texts(batch["text"]), 1 << 18):
                found = infer(model, data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][i:j], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.list_(pa.float64()))],
                    ["doc_id", "lang_pred", "score", "langs", "shares"],
                )

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (its share), langs and shares of the whole set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x places numbers
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _predict(shared, length), "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    """Whether crc32 of the id as text falls into the fold that is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5, length: int = LENGTH) -> DataFrame:
    """The rows of docs, columns as they are, in which one language has a share of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def identified(column: pa.Array) -> pa.Array:  # the other columns stay in the JVM
        good = [x[0] != "und" and x[1] >= least for _, _, data, offsets in slices(texts(column), 1 << 18) for x in infer(shared.value, data, offsets, length)]
        give_back()
        return pa.array(good, pa.bool_())

    return docs.filter(identified(F.col(text)))
