"""Interpolated modified Kneser-Ney language model of any order from 2, counted in Spark, memory-mapped by workers.

Tokens are the words of a text, A-Z lower-cased, and one end. Training takes one job for words and one for n-grams:

1. words are counted by their 64-bit hashes, combined in each task before the shuffle. Each bucket's owner writes a file:
   sorted hashes, each word's rank by count in its bucket (rank and bucket are its number), and counts by rank in runs;
2. each task turns its tokens into word numbers, combines its n-grams and deals them by a hash of their context (all words
   but the last). A bucket's owner sums them, writes the file of the highest level and passes on to the level below how
   many different words precede each suffix. Each lower level does the same, down to single words. All n-grams of a
   context lie in one file, so what a context needs (its total, how many n-grams have value 1, 2, 3 or more) is there.

Rows between tasks are columns of small numbers, sorted, as differences, and compressed. Buckets are as many as hold
TOKENS_A_BUCKET tokens each, so tasks stay the same size as the corpus grows; a context has at most as many rows in a
blob as there are words.

The highest level has counts, lower ones have how many different words precede an n-gram; n-grams that begin a text have
no such word and keep their counts. A text is begun once, so its first tokens have shorter contexts. Each level's
discounts come from its counts of counts. A file of n-grams is a sorted array of its contexts' hashes (a table over their
first bits, and the next 32), the number of n-grams of each, and their last words in order with their values. Workers map the
files and look up whole batches. Files are written in one step under fixed names: a retried task replaces them by the same.

Words are known by 64 bits, contexts of n-grams by the bucket's bits, the table's and 32 more. Defined results: a null
text is empty and has the end only. With nothing to learn from, every token has probability 1. Repeated rows count, and
are scored, each for itself. An empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, map_file, mix, put_file, shared_folder, slices, word_hashes

#: The hash of a text's end; numbers of an unknown word and of what is before a text. Words are numbered from FIRST.
END, UNKNOWN, BEGIN, FIRST = np.uint64(1), 0, 1, 2
#: Tokens that a task combines at a time; tokens to a bucket; tokens scored at a time, and bytes of text read at a time.
FLUSH, TOKENS_A_BUCKET, SCORE_TOKENS, SCORE_BYTES = 1_000_000, 2_000_000, 1_000_000, 4 << 20
#: Contexts with more n-grams than this have their sums stored; contexts to an entry of a file's table (a power of 2).
LONG, A_SLOT = 31, 4
#: Bits that a word's number may have; contexts of a file that are looked up at a time.
WORD_BITS, AT_A_TIME = 44, 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROW = "bucket int, grams binary, stats binary"
#: Sums of a level: n-grams of values 1 to 4, distinct n-grams, all values.
_STATS = 6


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, each text ending in END, and where each text begins."""
    words, bounds = word_hashes(data, offsets)
    n = len(bounds) - 1
    out, inside = np.full(len(words) + n, END, np.uint64), np.ones(len(words) + n, bool)
    inside[bounds[1:] + np.arange(n)] = False
    out[inside] = np.maximum(words, np.uint64(2))
    return out, bounds[:-1] + np.arange(n)


def windows(word: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of each token's n-gram, BEGIN in front of the first one and of the ones before it."""
    out = [word]
    while len(out) < order:
        earlier = np.empty_like(word)
        earlier[1:] = out[0][:-1]
        earlier[starts] = BEGIN
        out.insert(0, earlier)
    return out


def context_hash(words: list[np.ndarray]) -> np.ndarray:
    key = mix(words[0].astype(np.uint64) + _ODD)
    for w in words[1:]:
        key = mix(key * _ODD + w.astype(np.uint64))
    return key


def _top(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)


# -- columns of small numbers ----------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """Numbers as arrays of their bytes, lowest first, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(raw[:, k]) for k in range(width)]


def _take(planes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = planes[0][at].astype(np.int64)
    for k, plane in enumerate(planes[1:], 1):
        out |= plane[at].astype(np.int64) << (8 * k)
    return out


def _packed(words: list[np.ndarray], value: np.ndarray) -> bytes:
    """A compressed blob of n-grams that are in order, and their values."""
    columns = [_planes(x) for x in (np.diff(words[0], prepend=words[0].dtype.type(0)), *words[1:], value)]
    raw = np.array([len(value), *map(len, columns)], "<i8").tobytes() + b"".join(p.tobytes() for c in columns for p in c)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(blobs: list[bytes], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in range(n_words + 1)]
    for blob in blobs:
        raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8)
        n, *widths = raw[: 8 * (n_words + 2)].view("<i8").tolist()
        at = 8 * (n_words + 2)
        for k, width in enumerate(widths):
            wide = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
            for j in range(width):
                wide[:, j] = raw[at : at + n]
                at += n
            x = wide.view(np.uint32 if width <= 4 else np.uint64).ravel()
            columns[k].append(np.cumsum(x, dtype=np.uint64) if not k else x)
    whole = [np.concatenate([np.zeros(0, np.uint32), *x]) for x in columns]
    small = [x.astype(np.uint32) if len(x) and x.max() < 2**32 else x for x in whole[:-1]]
    return small, whole[-1].astype(np.int64)


def _combined(words: list[np.ndarray], value: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order, and their values' sums."""
    order, new = _ordered(words)
    at = np.flatnonzero(new)
    first = order[at]
    return [w[first] for w in words], np.add.reduceat(value[order], at) if len(at) else value[:0]


def _ordered(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams, and which of them, in order, differ from the one before.

    Each step sorts single 64-bit keys: the place of what the words before make up, and the next word (or two, at first).
    """
    wide = [int(w.max()).bit_length() if len(w) else 0 for w in words]
    order, place, bits = None, words[0], wide[0]
    for k, word in enumerate([*words[1:], None], 1):
        if word is not None and bits + wide[k] <= 64:
            key = (place.astype(np.uint64) << np.uint64(wide[k])) | word.astype(np.uint64)
            place, bits = key, bits + wide[k]
            continue
        order = np.argsort(place)
        ordered = place[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if word is None:
            return order, new
        place = np.empty(len(order), np.uint64)
        place[order] = np.cumsum(new) - 1
        bits = len(order).bit_length()
        if bits + wide[k] > 64:  # neither does this fit a key
            break
        place, bits = (place << np.uint64(wide[k])) | word.astype(np.uint64), bits + wide[k]
    order, new = np.lexsort(words[::-1]), np.zeros(len(words[0]), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[order[1:]] != w[order[:-1]]
    return order, new


def _rows(words: list[np.ndarray], value: np.ndarray, bucket: np.ndarray, stats: tuple[int, np.ndarray] | None = None) -> pa.Table:
    """Rows for the next level's owners: n-grams that are in order, dealt to buckets, and a row of sums."""
    order = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    full, at = np.unique(bucket[order], return_index=True)
    cut = [order[i:j] for i, j in zip(at, [*at[1:], len(order)], strict=True)]
    rows = [(b, _packed([w[s] for w in words], value[s]), None) for b, s in zip(full.tolist(), cut, strict=True)]
    if stats:
        rows.append((stats[0], None, stats[1].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["bucket", "grams", "stats"])


# -- words -----------------------------------------------------------------------------------------------------


def _count_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, n = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, value = _combined([np.concatenate([keys, *parts])], np.concatenate([counts, np.ones(n, np.int64)]))
            return words[0], value

        for batch in batches:
            for _, _, data, offsets in slices(batch["text"]):
                parts.append(tokens(data, offsets)[0])
                n += len(parts[-1])
                if n >= FLUSH:
                    keys, counts = merged()
                    parts, n = [], 0
                    if len(keys) >= 2 * FLUSH:
                        yield from _rows([keys], counts, _top(keys, bits)).combine_chunks().to_batches()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield from _rows([keys], counts, _top(keys, bits)).combine_chunks().to_batches()

    return run


def _word_file(folder: str) -> Callable:
    """Sum a bucket's words and write its file: sorted hashes, ranks by count, and counts by rank in runs."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        words, count = _unpacked(group["grams"].to_pylist(), 1)
        (hashes,), count = _combined([words[0].astype(np.uint64)], count)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        falling = count[order]
        runs = np.flatnonzero(np.diff(falling, prepend=-1))
        ranks = _planes(rank)
        put_file(f"{folder}/words-{key[0].as_py():06d}", [np.array([len(hashes), len(ranks), len(runs)], np.int64), hashes, runs.astype(np.int64), falling[runs], *ranks])
        return pa.table({"types": pa.array([len(hashes)], pa.int64()), "tokens": pa.array([int(count.sum())], pa.int64())})

    return run


class Words:
    """Numbers and counts of words, from memory-mapped files."""

    def __init__(self, folder: str, bits: int) -> None:
        self.folder, self.bits, self.files = folder, bits, {}

    def file(self, bucket: int) -> tuple:
        if bucket not in self.files:
            raw = map_file(f"{self.folder}/words-{bucket:06d}")
            n, width, runs = raw[:24].view(np.int64).tolist() if len(raw) else (0, 0, 0)
            longs = raw[24 : 24 + 8 * (n + 2 * runs)]
            bytes_ = raw[24 + 8 * (n + 2 * runs) :]
            self.files[bucket] = longs[: 8 * n].view(np.uint64), longs[8 * n : 8 * (n + runs)].view(np.int64), longs[8 * (n + runs) :].view(np.int64), [bytes_[n * k : n * (k + 1)] for k in range(width)]
        return self.files[bucket]

    def find(self, asked: np.ndarray, with_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct words in order (UNKNOWN if there is none) and, if asked for, their counts."""
        number, count = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        bucket = _top(asked, self.bits)
        full, at = np.unique(bucket, return_index=True)
        for b, i, j in zip(full.tolist(), at.tolist(), [*at[1:].tolist(), len(asked)], strict=True):
            known, starts, counts, ranks = self.file(b)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, asked[i:j]), len(known) - 1)
            hit = np.flatnonzero(known[place] == asked[i:j])
            rank = _take(ranks, place[hit])
            number[i + hit] = FIRST + (rank << self.bits) + b
            if with_counts:
                count[i + hit] = counts[np.searchsorted(starts, rank, "right") - 1]
        return number, count


# -- n-grams ---------------------------------------------------------------------------------------------------


def _count(words: Words, bits: int, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, n = Words(words.folder, words.bits), [], 0

        def flush() -> list[pa.RecordBatch]:
            grams = [np.concatenate(x) for x in zip(*parts, strict=True)]
            grams, value = _combined(grams, np.ones(len(grams[0]), np.int64))
            return _rows(grams, value, _top(context_hash(grams[:-1]), bits)).combine_chunks().to_batches()

        for batch in batches:
            for _, _, data, offsets in slices(batch["text"]):
                word, starts = tokens(data, offsets)
                asked, back = np.unique(word, return_inverse=True)
                number = known.find(asked)[0][back]
                parts.append(windows(number.astype(np.uint32) if number.max() < 2**32 else number, starts, order))
                n += len(word)
                if n >= FLUSH:
                    yield from flush()
                    parts, n = [], 0
        if n:
            yield from flush()

    return run


def _file(bits: int, words: list[np.ndarray], value: np.ndarray) -> list[np.ndarray]:
    """A file's content: n-grams, which are in order, by the hashes of their contexts."""
    new = np.zeros(len(value), bool)
    new[:1] = True
    for w in words[:-1]:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(value)))
    rest = context_hash([w[first] for w in words[:-1]]) << np.uint64(bits)
    order = np.argsort(rest, kind="stable")
    rest, size, first = rest[order], size[order], first[order]
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size) + np.arange(len(value))
    last, value = words[-1][at], value[at]
    n = len(rest)
    p = max(0, (n // A_SLOT).bit_length() - 1) if n else 0
    slots = np.searchsorted(rest, np.arange(1 << p, dtype=np.uint64) << np.uint64(64 - p)) if p else np.zeros(1, np.int64)
    slots = np.append(slots, n)
    base = np.append(ends - size, len(value))[slots]
    low = ((rest << np.uint64(p)) >> np.uint64(32)).astype(np.uint32)
    long = np.flatnonzero(size > LONG)
    sums = [np.add.reduceat(x, (ends - size)).astype(np.int64)[long] if n else np.zeros(0, np.int64) for x in (value, value == 1, value == 2, value > 2)]
    big = np.flatnonzero(value > 255)
    kind, wide = np.uint32 if len(value) < 2**32 else np.int64, 4 if not n or last.max() < 2**32 else 8
    head = np.array([n, len(value), p, len(long), len(big), wide, np.dtype(kind).itemsize], np.int64)
    return [head, long, size[long], *sums, big, value[big], slots.astype(kind), base.astype(kind), low, last.astype(f"<u{wide}"), np.minimum(size, LONG + 1).astype(np.uint8), np.minimum(value, 255).astype(np.uint8)]


def _level_file(folder: str, word_bits: int, bits: int, order: int, level: int) -> Callable:
    """Sum a bucket's n-grams of a level, write its file and pass on the shares of the level below."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        grams, value = _combined(*_unpacked(group["grams"].drop_null().to_pylist(), level))
        # A text's first tokens come up with BEGIN twice or more; they are n-grams of a lower level.
        whole = grams[1] != BEGIN if level > 1 else np.ones(len(value), bool)
        n = value[whole]
        stats = np.sum([np.zeros(_STATS * order, np.int64), *(np.frombuffer(x, np.int64) for x in group["stats"].drop_null().to_pylist())], axis=0)
        stats[_STATS * (level - 1) : _STATS * level] += [*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()]
        if level == 1:
            dense = np.zeros(int((grams[0].max() - FIRST) >> word_bits) + 1 if len(n) else 0, np.int64)
            dense[(grams[0].astype(np.int64) - FIRST) >> word_bits] = n
            planes = _planes(dense)
            put_file(f"{folder}/grams1-{bucket:06d}", [np.array([len(dense), len(planes)], np.int64), *planes])
            return pa.table({"stats": pa.array([stats.tobytes()], pa.binary())})
        put_file(f"{folder}/grams{level}-{bucket:06d}", _file(bits, [w[whole] for w in grams], n))
        # What begins a text has no word before it: its count is carried on. All else counts once for the word before it.
        below, value = _combined(grams[1:], np.where(grams[1] == BEGIN, value, 1))
        to = _top(context_hash(below[:-1]), bits) if level > 2 else ((below[0].astype(np.int64) - FIRST) & ((1 << word_bits) - 1)).astype(np.int32)
        return _rows(below, value, to, (bucket if level > 2 else bucket & ((1 << word_bits) - 1), stats))

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from counts of counts 1 to 4, kept within what they are taken from."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), 0.95 * k) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


@dataclass
class Model:
    """Where the files are, and the few numbers that the driver holds."""

    folder: str
    word_bits: int
    bits: int
    types: int
    tokens: int
    bigrams: int
    discounts: list[list[float]]  # of words, bigrams and so on
    word_rest: float  # mass that the words' discounts leave for the uniform distribution

    @property
    def order(self) -> int:
        return len(self.discounts)


def train(docs: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Count the n-grams of all rows, up to `order` words. The driver gets a few sums for each level."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    rows = docs.select(F.col(text).alias("text"))
    folder = shared_folder(docs.sparkSession, "lm")
    word_bits = max(2, math.ceil(math.log2(max(1, rows.rdd.getNumPartitions()))))
    words = map_arrow(rows, _count_words(word_bits), _ROW).groupBy("bucket").applyInArrow(_word_file(folder), "types long, tokens long")
    types, n = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    bits = max(2, math.ceil(math.log2(max(1, n / TOKENS_A_BUCKET))))
    if not n:
        return Model(folder, word_bits, bits, 0, 0, 0, [[0.5, 1.0, 1.5]] * order, 1.0)
    shares = map_arrow(rows, _count(Words(folder, word_bits), bits, order), _ROW)
    for level in range(order, 0, -1):
        shares = shares.groupBy("bucket").applyInArrow(_level_file(folder, word_bits, bits, order, level), _ROW if level > 1 else "stats binary")
    found = {r["at"]: r["value"] for r in map_arrow(shares, _unpack_stats, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    levels = [[found.get(k, 0) for k in range(_STATS * level, _STATS * (level + 1))] for level in range(order)]
    d = [discounts(x[:4]) for x in levels]
    n1, n2, _, _, different, bigrams = levels[0]
    return Model(folder, word_bits, bits, types, n, bigrams, d, (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * (different - n1 - n2)) / bigrams)


def _unpack_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch["stats"].to_pylist():
            values = np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["at", "value"])


def _spread(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n places from `at`, side by side: where each begins, and of each place its run and the place itself."""
    starts = np.cumsum(n) - n
    who = np.repeat(np.arange(len(n)), n)
    return starts, who, np.arange(len(who)) + (at - starts)[who]


class Contexts:
    """One memory-mapped file of n-grams."""

    def __init__(self, raw: np.ndarray, bits: int) -> None:
        self.bits, self.n = np.uint64(bits), 0
        if not len(raw):
            return
        self.n, n_grams, self.p, n_long, n_big, wide, item = raw[:56].view(np.int64).tolist()
        at = 56

        def next_(n: int, kind: type) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return raw[at - n * np.dtype(kind).itemsize : at].view(kind)

        self.long, *self.sums = (next_(n_long, np.int64) for _ in range(6))
        self.big, self.big_value = (next_(n_big, np.int64) for _ in range(2))
        kind = np.uint32 if item == 4 else np.int64
        self.slots, self.base = (next_((1 << self.p) + 1, kind) for _ in range(2))
        self.low, self.last = next_(self.n, np.uint32), next_(n_grams, np.uint32 if wide == 4 else np.uint64)
        self.size, self.value = next_(self.n, np.uint8), next_(n_grams, np.uint8)

    def sizes(self, at: np.ndarray) -> np.ndarray:
        """How many n-grams contexts have."""
        size = self.size[at].astype(np.int64)
        many = np.flatnonzero(size > LONG)
        size[many] = self.sums[0][np.searchsorted(self.long, at[many])]
        return size

    def values(self, at: np.ndarray) -> np.ndarray:
        value = self.value[at].astype(np.int64)
        many = np.flatnonzero(value == 255)
        if len(many) and len(self.big):
            place = np.minimum(np.searchsorted(self.big, at[many]), len(self.big) - 1)
            hit = self.big[place] == at[many]
            value[many[hit]] = self.big_value[place[hit]]
        return value

    def locate(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct contexts by their hashes: which are found; their places, first n-grams and numbers of n-grams."""
        rest = key << self.bits
        slot = (rest >> np.uint64(64 - self.p)).astype(np.int64) if self.p else np.zeros(len(key), np.int64)
        low = ((rest << np.uint64(self.p)) >> np.uint64(32)).astype(np.uint32)
        at = self.slots[slot].astype(np.int64)
        # All contexts of the keys' slots, one slot after the other, and the n-grams before each of them.
        starts, who, here = _spread(at, self.slots[slot + 1] - at)
        hit = np.flatnonzero(self.low[here] == low[who])
        found = who[hit]
        if len(found) > 1 and not (once := np.append(True, found[1:] != found[:-1])).all():
            hit, found = hit[once], found[once]
        size = self.sizes(here)
        ends = np.cumsum(size)
        before = ends[hit] - size[hit] - np.where(starts[found] > 0, ends[starts[found] - 1], 0)
        return found, here[hit], self.base[slot[found]].astype(np.int64) + before, size[hit]

    def find(self, key: np.ndarray, asked: np.ndarray, ends: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of words that are asked for in distinct contexts, 0 for those that never follow; and of the contexts their
        totals (0 for unknown ones) and the shares of these that discounts leave. The words of key[i] end at ends[i]."""
        value, total, rest = np.zeros(len(asked), np.int64), np.zeros(len(key)), np.ones(len(key))
        if not self.n:
            return value, total, rest
        found, at, first, size = self.locate(key)
        begins = np.append(0, ends[:-1])
        long = size > LONG
        for many in (False, True):
            some = np.flatnonzero(long == many)
            if not len(some):
                continue
            which, n = found[some], size[some]
            _, who, words = _spread(begins[which], ends[which] - begins[which])
            if many:
                place = np.searchsorted(self.long, at[some])
                sum_, n1, n2 = (x[place] for x in self.sums[1:4])
                value[words] = self.search(first[some][who], n[who], asked[words])
            else:  # few n-grams each: all of them are taken, one context after the other
                starts, of, grams = _spread(first[some], n)
                v = self.values(grams)
                sum_, n1, n2 = (np.add.reduceat(x, starts, dtype=np.int64) for x in (v, v == 1, v == 2))
                keys = (of << WORD_BITS) | self.last[grams].astype(np.int64)
                wanted = (who << WORD_BITS) | asked[words]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                value[words] = np.where(keys[place] == wanted, v[place], 0)
            total[which] = sum_
            rest[which] = (d[0] * n1 + d[1] * n2 + d[2] * (n - n1 - n2)) / sum_
        return value, total, rest

    def search(self, first: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Values of words in contexts that begin at `first`; 0 for words that never follow."""
        at, n = first.copy(), size.copy()
        for _ in range(int(size.max()).bit_length()):  # the last one that isn't beyond the word: among n from `at`
            half = n >> 1
            at += half * (self.last[at + half] <= word)
            n -= half
        return np.where(self.last[at] == word, self.values(at), 0)


class Reader:
    """A model's memory-mapped files."""

    def __init__(self, model: Model) -> None:
        self.model, self.words, self.files = model, Words(model.folder, model.word_bits), {}

    def continuations(self, number: np.ndarray) -> np.ndarray:
        """How many different words precede each word."""
        asked = number - FIRST
        bucket = asked & ((1 << self.model.word_bits) - 1)
        value = np.zeros(len(asked), np.int64)
        for b in np.unique(bucket[asked >= 0]).tolist():
            if (1, b) not in self.files:
                raw = map_file(f"{self.model.folder}/grams1-{b:06d}")
                n, width = raw[:16].view(np.int64).tolist() if len(raw) else (0, 0)
                self.files[1, b] = n, [raw[16 + n * k : 16 + n * (k + 1)] for k in range(width)]
            n, planes = self.files[1, b]
            at = np.flatnonzero((bucket == b) & (asked >= 0) & (asked >> self.model.word_bits < n))
            if len(at):
                value[at] = _take(planes, asked[at] >> self.model.word_bits)
        return value

    def find(self, context: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of words after contexts, the contexts' totals, and the shares that discounts leave; 0, 0, 1 for unknown ones."""
        level, m = len(context) + 1, self.model
        known = np.flatnonzero(np.all([w != UNKNOWN for w in context], axis=0))
        key = context_hash([w[known] for w in context])
        order = np.argsort(key)
        known, key = known[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first, which, asked = np.flatnonzero(new), np.cumsum(new) - 1, word[known]
        key, begins = key[first], np.append(first, len(key))
        full, at = np.unique(_top(key, m.bits), return_index=True)
        value, total, rest = np.empty(len(asked), np.int64), np.empty(len(key)), np.empty(len(key))
        for b, low, high in zip(full.tolist(), at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
            if (level, b) not in self.files:
                self.files[level, b] = Contexts(map_file(f"{m.folder}/grams{level}-{b:06d}"), m.bits)
            for i in range(low, high, AT_A_TIME):
                j = min(high, i + AT_A_TIME)
                x, y = begins[i], begins[j]
                value[x:y], total[i:j], rest[i:j] = self.files[level, b].find(key[i:j], asked[x:y], begins[i + 1 : j + 1] - x, m.discounts[level - 1])
        out = np.zeros(len(word), np.int64), np.zeros(len(word)), np.ones(len(word))
        out[0][known], out[1][known], out[2][known] = value, total[which], rest[which]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score) of texts."""
        m = self.model
        hashes, starts = tokens(data, offsets)
        asked, back = np.unique(hashes, return_inverse=True)
        number, count = self.words.find(asked, with_counts=True)
        take = lambda n, d: np.array([0.0, *d])[np.minimum(n, 3)]  # noqa: E731  the discount of a value
        logs, base = np.zeros(len(back)), np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[back]
        if m.tokens:
            before = self.continuations(number)
            single = (before - take(before, m.discounts[0])) / m.bigrams + m.word_rest / (m.types + 1)
            grams = windows(number[back], starts, m.order)
        for i in range(0, len(back) if m.tokens else 0, SCORE_TOKENS):
            part = [w[i : i + SCORE_TOKENS] for w in grams]
            p = single[back[i : i + SCORE_TOKENS]]
            for level in range(2, m.order + 1):
                value, total, rest = self.find(part[m.order - level : -1], part[-1])
                p = (value - take(value, m.discounts[level - 1])) / np.maximum(total, 1) + rest * p
            logs[i : i + SCORE_TOKENS] = np.log10(p)
        sums = lambda x: np.add.reduceat(x, starts)
        return np.diff(np.append(starts, len(back))), sums((count > 0).astype(np.int64)[back]), sums(base), sums(logs)


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for i, j, data, offsets in slices(batch["text"], SCORE_BYTES):
                n, known, base, score = reader.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, base_score, score, perplexity (all log10 sums but the last)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = map_arrow(rows, _score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
