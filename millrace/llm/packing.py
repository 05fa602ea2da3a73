"""Packing token sequences by linear grouping.

Documents are tokenised (plus one end token); only those longer than a sequence are cut. The lengths' histogram, which
has at most `capacity` entries however many documents there are, is all that the planner needs:

1. large lengths are sorted into groups of equal cardinality (a length that fills a group is one by itself, and ends the
   group before it) and rounded up to their group's largest length;
2. configurations of these few sizes are optimised: the linear programme over all multisets that fit, by column
   generation (the pricing problem is a knapsack), rounded down;
3. actual lengths take the places of their groups, and large ones left over open bins best-fit first;
4. small lengths follow, longest first, each into the tightest bin that holds it.

Bins of equal content are kept as one pattern with a count, so the plan is small. Its places are numbered by length;
a piece finds its place by its rank among pieces of its length. Ranks come from windows over bounded salted slices of
a length plus offsets, so that a length of a third of all pieces isn't one task.

Defined results: a null text is empty and gives one piece, the end token. Repeated rows are packed each for itself.
Pieces of one length have places in any order. An empty table gives an empty result. Other columns stay away.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import encoded, map_arrow, materialize, sized

#: Tokens of a sequence; numbers of groups of large lengths that are tried; lengths of capacity / LARGE or more are large.
CAPACITY, GROUPS, LARGE = 4096, (24, 64), 8
#: Rounds of column generation after which something must be wrong; a programme of 64 sizes takes some hundreds.
ENDLESS = 20_000
#: Parts of texts whose ids a worker remembers, and pieces of one length that one window slice ranks.
CACHE_PARTS, SLICE_ROWS = 200_000, 2_000


# -- tokens ----------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in same else chr(256 + k) for k, b in [(sum(x not in same for x in range(b)), b) for b in range(256)]}


#: Texts of these characters alone need no normalisation but lower case; other control characters are left out.
_PLAIN = re.compile(r"[\t-\r -~¡-ÿ]*")
#: The tokenizer's own pattern, for plain texts: contractions, letters, single digits, anything else but white space.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


class PartEncoder:
    """Ids of texts by the installed tokenizer, part by part, remembering parts.

    Only for byte-level tokenizers that lower-case and drop white space, so that a text's ids are its parts' ids. Plain
    texts are cut into parts by the tokenizer's pattern here, and its model encodes each new part. In other texts this
    goes for plain words; all else (special tokens, letters beyond Latin-1, control characters) takes the whole
    tokenizer, word by word.
    """

    def __init__(self, path: str, most: int = CACHE_PARTS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def ids_of_plain(self, text: str) -> bytes:
        found, known = _PARTS.findall(text.lower()), self.parts
        for part in set(found).difference(known):
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            known[part] = _packed([t.id for t in self.tokenizer.model.tokenize(spelled)])
        return b"".join(map(known.__getitem__, found))

    def encode(self, text: bytes) -> bytes:
        """Little-endian uint32 ids of a UTF-8 text."""
        if len(self.parts) > self.most:
            self.parts.clear()
        whole = text.decode()
        if "<|" not in whole and _PLAIN.fullmatch(whole):
            return self.ids_of_plain(whole)
        out = []
        for word in text.split():
            w = word.decode()
            plain = "<|" not in w and _PLAIN.fullmatch(w)
            out.append(self.ids_of_plain(w) if plain else _packed(self.tokenizer.encode(w, add_special_tokens=False).ids))
        return b"".join(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, PartEncoder] = {}


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:  # workers are used again: so are parts
            _ENCODERS[path] = PartEncoder(path)
        encoder = _ENCODERS[path]
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            raw, ids = encoded(batch["text"]), batch["doc_id"].to_pylist()
            for i in range(0, len(raw), 200):
                rows: list[tuple] = []
                for doc, text in zip(ids[i : i + 200], raw[i : i + 200], strict=True):
                    tokens = encoder.encode(text) + end
                    for k in range(0, len(tokens), width):
                        piece = tokens[k : k + width]
                        rows.append((doc, k // width, k // 4, len(piece) // 4, zlib.crc32(piece), np.frombuffer(piece, "<u4").tolist() if with_ids else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.list_(pa.int64())], strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def tokenize(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and their ids if asked for."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_arrow(rows, _pieces(path, capacity, end_id, with_ids), schema)


# -- the plan --------------------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, as counts. A size's copies are added in whole-array passes."""
    best = np.zeros(capacity + 1)  # by room; never falls as room grows, as 0 is the start everywhere
    for k in np.flatnonzero(values > 1e-12).tolist():
        size = int(sizes[k])
        for _ in range(capacity // size):
            more = best[:-size] + values[k]
            gain = more > best[size:] + 1e-12
            if not gain.any():
                break
            best[size:][gain] = more[gain]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0 and best[room] > 1e-12:
        k = next((k for k in range(len(sizes)) if sizes[k] <= room and values[k] > 1e-12 and best[room - sizes[k]] + values[k] >= best[room] - 1e-9), None)
        if k is None:
            room -= 1
            continue
        counts[k] += 1
        room -= int(sizes[k])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ENDLESS) -> list[tuple[np.ndarray, float]]:
    """An optimal basis of the configuration programme: (counts of each size, bins), by column generation.

    Raises if it isn't reached in that many rounds.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount, dual = inverse @ demand, np.ones(n) @ inverse
        value, column = knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    else:
        raise RuntimeError(f"column generation has not ended after {rounds} rounds")
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, k].astype(np.int64), float(amount[k])) for k in range(n)]


class Bins:
    """Patterns of equal bins: content as ((length, times), ...), by the room that is left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
        self.rooms = np.zeros(capacity + 1, bool)

    def add(self, room: int, count: int, content: tuple) -> None:
        if count:
            self.by_room[room].append((count, content))
            self.rooms[room] = True

    def best_fit(self, length: int, n: int) -> None:
        """Put n pieces of a length into the tightest bins, opening new ones only when none has room."""
        while n:
            fits = np.flatnonzero(self.rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                count, content = self.by_room[room].pop()
                self.rooms[room] = bool(self.by_room[room])
            else:
                room, content = self.capacity, ()
                count = -(-n // (room // length))
            times = room // length
            full = min(count, n // times)
            self.add(room - times * length, full, (*content, (length, times)))
            n, count = n - full * times, count - full
            if count and n:  # one bin gets what is left, which is less than it could hold
                self.add(room - n * length, 1, (*content, (length, n)))
                n, count = 0, count - 1
            self.add(room, count, content)

    def patterns(self) -> list[tuple[int, tuple]]:
        return [x for room in sorted(self.by_room) for x in self.by_room[room] if x[1]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, large: int = LARGE) -> list[tuple[int, tuple]]:
    """Patterns (bins, ((length, times), ...)) that hold all pieces of a histogram of lengths: of several numbers of groups the fewest bins."""
    return min((grouped_plan(histogram, capacity, n, large) for n in groups), key=lambda patterns: sum(count for count, _ in patterns))


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large: int) -> list[tuple[int, tuple]]:
    """A plan by linear grouping with one number of groups."""
    bins = Bins(capacity)
    bins.add(0, histogram.get(capacity, 0), ((capacity, 1),))
    big = sorted((x for x in histogram if capacity // large <= x < capacity), reverse=True)
    left = {x: histogram[x] for x in big}
    total = sum(left.values())
    if total:
        # Groups of equal cardinality over the sorted lengths: each is a list of runs (length, number).
        each, runs, members = -(-total // groups), [], []
        for length in big:
            n = histogram[length]
            if n >= each:  # as many as a group or more of one length need no rounding
                runs += [members, [[length, n]]] if members else [[[length, n]]]
                members, n = [], 0
            while n:
                take = min(n, each - sum(m for _, m in members))
                members.append([length, take])
                n -= take
                if sum(m for _, m in members) == each:
                    runs.append(members)
                    members = []
        runs += [members] if members else []
        by_size: dict[int, list] = {}
        for group in runs:  # groups of the same largest length are one
            by_size.setdefault(group[0][0], []).extend(group)
        sizes = np.array(sorted(by_size), np.int64)
        demand = np.array([sum(m for _, m in by_size[s]) for s in sizes.tolist()], float)
        for counts, amount in configurations(sizes, demand, capacity):
            todo = int(amount + 1e-9)
            slots = [by_size[s] for s, c in zip(sizes.tolist(), counts.tolist(), strict=True) for _ in range(c)]
            todo = min([todo, *(sum(m for _, m in by_size[s]) // c for s, c in zip(sizes.tolist(), counts.tolist(), strict=True) if c)])
            # Each slot takes its next `todo` actual lengths; where one of them changes, a new pattern begins.
            taken = []
            for slot in slots:
                need, part = todo, []
                while need:
                    take = min(need, slot[0][1])
                    part.append([slot[0][0], take])
                    slot[0][1] -= take
                    need -= take
                    if not slot[0][1]:
                        slot.pop(0)
                taken.append(part)
            while todo:
                step = min(part[0][1] for part in taken)
                content: dict[int, int] = defaultdict(int)
                for part in taken:
                    content[part[0][0]] += 1
                    left[part[0][0]] -= step
                    part[0][1] -= step
                    if not part[0][1]:
                        part.pop(0)
                bins.add(capacity - sum(x * m for x, m in content.items()), step, tuple(content.items()))
                todo -= step
    for length in sorted(histogram, reverse=True):
        if length < capacity:
            bins.best_fit(length, left.get(length, histogram[length] if length not in left else 0))
    return bins.patterns()


class Places:
    """Where the r-th piece of a length goes, from a plan."""

    def __init__(self, patterns: list[tuple[int, tuple]]) -> None:
        rows, first, used = [], 0, defaultdict(int)
        for count, content in patterns:
            at = 0
            for length, times in content:
                rows.append((length, used[length], first, times, at))
                used[length] += count * times
                at += length * times
            first += count
        rows.sort()
        self.n_bins = first
        self.length, self.rank, self.first, self.times, self.at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
        self.order = self.length * (1 << 46) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.order, length * (1 << 46) + rank, "right") - 1
        rank = rank - self.rank[k]
        return self.first[k] + rank // self.times[k], self.at[k] + rank % self.times[k] * length


def _place(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(np.array(batch["length"]), np.array(batch["rank"]))
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), which are written with a number each."""
    columns = pieces.columns
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    places = Places(plan(counts, capacity))
    spark = pieces.sparkSession
    numbers = spark.createDataFrame([(k, -(-n // SLICE_ROWS)) for k, n in counts.items()], "length long, slices long")
    salted = pieces.join(F.broadcast(numbers), "length")  # one row a length
    salted = salted.withColumn("slice", F.pmod(F.xxhash64("__row"), F.col("slices"))).drop("slices")
    sizes = materialize(salted.groupBy("length", "slice").agg(F.count("*").alias("n")), "slices")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(sizes.select("length", "slice", before.alias("before")), "offsets")
    row = F.row_number().over(Window.partitionBy("length", "slice").orderBy("__row")) - 1
    ranked = salted.withColumn("row", row).join(sized(offsets), ["length", "slice"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("row")).cast("long")).select(*columns, "rank")
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "__row")
    return map_arrow(ranked, _place(spark.sparkContext.broadcast(places)), f"{names}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack all rows of docs: one row for each piece."""
    return pack_pieces(tokenize(docs, path, text, doc_id, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids), from pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence is bounded by its capacity
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
