"""Exact deduplication by an extendible-hash index in shared files.

Texts are equal when they are the same bytes after every character of [\\x20\\x09-\\x0D] is deleted. The work has
three scans of a partition's rows and no group is ever collected:

1. keys: each row's normalised text is hashed to a 64-bit key; keys are counted (combined before the shuffle), and
   only keys held by two rows or more enter the index, each with one representative row;
2. build: a directory over key prefixes doubles wherever a bucket would overflow its page; each bucket's owner task
   writes its key range's page (sorted keys, representatives' bytes) into the shared folder;
3. probe: each row finds its key's page through the directory and compares bytes with the page's entry. A row whose
   bytes differ (a collision) is chained: it goes to a next generation of the index, until no row is left.

A group is thus known by (key, generation), with hot groups costing one index entry and one combined count.

Defined results: a null text counts as empty, and all empty texts are one group. Ties for the row that stays go to
the smallest doc_id (a null one last), then to one of the fully equal rows. Rows with equal doc_id stay separate
rows. An empty table gives an empty result. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import encoded, map_arrow, map_file, materialize, put_file, shared_folder, sized

_BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of normalised text, and entries, that a page (a bucket) may hold before the directory splits it.
PAGE_BYTES, PAGE_ENTRIES = 16 << 20, 65_536
#: Prefix bits that the first histogram of keys resolves, those that each further doubling adds at once, and the most
#: that the directory may have (a 64 MB array).
FIRST_BITS, MORE_BITS, MOST_BITS = 10, 7, 24
#: Pages that one worker keeps mapped at a time.
MAPPED_PAGES = 128


def hash64(normal: bytes) -> int:
    """The index key: 64 bits of BLAKE2b, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(normal, digest_size=8).digest(), "little", signed=True)


class Directory:
    """An extendible-hash directory: 2**depth slots by key prefix, several slots to a bucket that is less deep."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = np.zeros(1, np.int32)
        self.buckets: list[tuple[int, int]] = [(0, 0)]  # (local depth, prefix)

    def split(self, bucket: int) -> None:
        """Split a bucket in two by its next prefix bit, doubling the directory if it has as many bits as that."""
        local, prefix = self.buckets[bucket]
        if local == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        self.buckets[bucket] = (local + 1, prefix << 1)
        self.buckets.append((local + 1, (prefix << 1) | 1))
        width = 1 << (self.depth - local - 1)
        first = ((prefix << 1) | 1) * width
        self.slots[first : first + width] = len(self.buckets) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The buckets of keys (uint64)."""
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)]


def _folded(n: np.ndarray) -> list[np.ndarray]:
    """Sums over all shorter prefixes: level d has 2 ** d numbers."""
    levels = [n]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
    return levels


def build_directory(keys: DataFrame, page_bytes: int, page_entries: int) -> Directory:
    """Split buckets until each fits a page or holds one key prefix of MOST_BITS (such a page only grows).

    keys: (key, n_bytes). The driver gets arrays of 2 ** MORE_BITS sums below each overfull bucket only, so their number
    follows that of the pages; the overfull prefixes go back as a table.
    """
    directory, bits, more = Directory(), 0, FIRST_BITS
    spark, over = keys.sparkSession, [(0, 0)]  # (bucket, prefix of `bits` bits)
    while over and bits < MOST_BITS:
        more = min(more, MOST_BITS - bits)
        asked = keys.withColumn("p", F.shiftrightunsigned("key", 64 - bits - more))
        if bits:
            prefixes = spark.createDataFrame(pa.table({"at": pa.array([p for _, p in over], pa.int64())}))
            asked = asked.withColumn("at", F.shiftrightunsigned("key", 64 - bits)).join(sized(prefixes), "at")
        found = asked.groupBy("p").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).toArrow()
        p, n, b = (found[c].to_numpy() for c in ("p", "n", "b"))
        order = np.argsort(p)
        p, n, b, next_ = p[order], n[order], b[order], []
        for bucket, prefix in over:
            i, j = np.searchsorted(p, [prefix << more, (prefix + 1) << more])
            entries, held = np.zeros(1 << more, np.int64), np.zeros(1 << more, np.int64)
            entries[p[i:j] - (prefix << more)], held[p[i:j] - (prefix << more)] = n[i:j], b[i:j]
            entries, held, todo = _folded(entries), _folded(held), [bucket]
            while todo:
                at = todo.pop()
                depth, name = directory.buckets[at][0] - bits, directory.buckets[at][1] - (prefix << (directory.buckets[at][0] - bits))
                if entries[depth][name] < 2 or (entries[depth][name] <= page_entries and held[depth][name] <= page_bytes):
                    continue  # it fits, or is a single key, which can't be split
                if depth < more:
                    directory.split(at)
                    todo += [at, len(directory.buckets) - 1]
                else:
                    next_.append((at, directory.buckets[at][1]))
        over, bits, more = next_, bits + more, MORE_BITS
    return directory


class Index:
    """Read access to the pages of one generation, from a worker."""

    def __init__(self, folder: str, directory: Directory) -> None:
        self.folder, self.directory = folder, directory
        self.pages: OrderedDict[int, tuple] = OrderedDict()

    def page(self, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if bucket not in self.pages:
            raw = map_file(f"{self.folder}/page-{bucket:08d}")
            n = int(raw[:8].view(np.int64)[0]) if len(raw) else 0
            keys, ends = raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
            self.pages[bucket] = keys, ends, raw[16 + 16 * n :]
            while len(self.pages) > MAPPED_PAGES:
                self.pages.popitem(last=False)
        self.pages.move_to_end(bucket)
        return self.pages[bucket]

    def compare(self, key: int, bucket: int, normal: bytes) -> int:
        """1: the entry has these bytes, 0: other bytes, -1: there is no such key."""
        keys, ends, blob = self.page(bucket)
        at = int(np.searchsorted(keys, np.uint64(key)))
        if at == len(keys) or int(keys[at]) != key:
            return -1
        return int(blob[ends[at] : ends[at + 1]].tobytes() == normal)


def _keys(text: str, doc_id: str, hash_key: Callable[[bytes], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = [t.translate(None, _BLANK) for t in encoded(batch[text])]
            yield pa.RecordBatch.from_arrays(
                [batch[doc_id], pa.array([hash_key(t) for t in normal], pa.int64()), pa.array([len(t) for t in normal], pa.int64())],
                ["doc_id", "key", "n_bytes"],
            )

    return run


def _normals(hash_key: Callable[[bytes], int], shared: object) -> Callable:
    """Of representatives' rows: keys, normalised bytes and their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        for batch in batches:
            normal = [t.translate(None, _BLANK) for t in encoded(batch["text"])]
            keys = np.array([hash_key(t) for t in normal], np.int64)
            buckets = directory.find(keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(keys, pa.int64()), pa.array(normal, pa.binary())], ["bucket", "key", "normal"])

    return run


def _owner(folder: str) -> Callable:
    """Write the page of one bucket: its keys in order, one entry a key."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys = np.array(group["key"].to_pylist(), np.int64).view(np.uint64)
        normal = group["normal"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], normal[i]))
        kept = [i for k, i in enumerate(order) if not k or keys[i] != keys[order[k - 1]]]
        ends = np.concatenate([[0], np.cumsum([len(normal[i]) for i in kept])]).astype(np.int64)
        put_file(f"{folder}/page-{key[0].as_py():08d}", [np.array([len(kept)], np.int64), keys[kept], ends, b"".join(normal[i] for i in kept)])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "entries": pa.array([len(kept)], pa.int64())})

    return run


def _probe(text: str, doc_id: str, hash_key: Callable[[bytes], int], folder: str, shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        index = Index(folder, directory)
        for batch in batches:
            raw = encoded(batch[text])
            normal = [t.translate(None, _BLANK) for t in raw]
            keys = np.array([hash_key(t) for t in normal], np.int64)
            buckets = directory.find(keys.view(np.uint64)).tolist()
            found = [index.compare(k, b, t) for k, b, t in zip(keys.view(np.uint64).tolist(), buckets, normal, strict=True)]
            points = pc.utf8_length(pa.array(raw, pa.large_binary()).cast(pa.large_string())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch[doc_id], pa.array(keys, pa.int64()), points, pa.array([hashlib.sha256(t).hexdigest() for t in normal], pa.string()), pa.array(found, pa.int32())],
                ["doc_id", "key", "n_points", "text_sha256", "found"],
            )

    return run


def index_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_key: Callable[[bytes], int] = hash64, page_bytes: int = PAGE_BYTES, page_entries: int = PAGE_ENTRIES) -> DataFrame:
    """One row for each row of docs: uid, doc_id, key, generation, shared, n_points, text_sha256.

    (key, generation) names the group of equal texts; shared is false if the row is certainly alone in it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    done, rest, generation = None, docs, 0
    while True:
        keyed = map_arrow(rest, _keys("text", "doc_id", hash_key), "doc_id long, key long, n_bytes long")
        twice = materialize(
            keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes")).filter("n > 1" if not generation else "n > 0"),
            "keys",
        )
        directory = spark.sparkContext.broadcast(build_directory(twice, page_bytes, page_entries))  # 2 ** MOST_BITS slots at most
        folder = shared_folder(spark, "pages")
        # Each row of a representative's id comes once, whatever other keys that id stands for; a key's representative
        # is then the least text of its rows among them (the same one, unless keys collide, as an id has mostly one row).
        ids = twice.filter("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
        reps = rest.join(sized(ids), "doc_id", "left_semi")
        if not twice.filter("rep is null").isEmpty():  # all rows of some key have no id
            reps = reps.unionByName(rest.filter("doc_id is null"))
        pages = map_arrow(reps, _normals(hash_key, directory), "bucket int, key long, normal binary").join(sized(twice.select("key")), "key", "left_semi")
        pages = pages.groupBy("bucket", "key").agg(F.min("normal").alias("normal"))
        written = pages.groupBy("bucket").applyInArrow(_owner(folder), "bucket int, entries long")
        written.agg(F.sum("entries")).collect()
        rows = map_arrow(rest, _probe("text", "doc_id", hash_key, folder, directory), "doc_id long, key long, n_points long, text_sha256 string, found int")
        rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("generation", F.lit(generation))
        rows = materialize(rows, "rows")
        settled = rows.filter("found != 0").select("uid", "doc_id", "key", "generation", (F.col("found") > 0).alias("shared"), "n_points", "text_sha256")
        done = settled if done is None else done.unionByName(settled)
        chained = rows.filter("found = 0").select("doc_id", "text_sha256").distinct()
        if chained.isEmpty():
            return done
        again = rest.withColumn("__sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), _BLANK.decode(), ""), 256))
        chained = chained.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__s"))
        same = again["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__s"))
        rest = materialize(again.join(chained, same, "left_semi").drop("__sha"), "chain")
        generation += 1


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **index: object) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    keep_id is the row with the most code points in the original text, then the smallest doc_id; exactly one row of
    each group is kept, also where doc_ids repeat.
    """
    rows = index_rows(docs, text, doc_id, **index)
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    groups = materialize(
        rows.filter("shared").groupBy("key", "generation").agg(F.count("*").alias("group_size"), best)
        .select("key", "generation", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid")),
        "groups",
    )
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_points"]
    alone = rows.filter("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points")
    several = rows.filter("shared").join(sized(groups), ["key", "generation"]).withColumn("kept", F.col("uid") == F.col("keep_uid")).select(*out)
    return alone.unionByName(several)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns as they are.

    Rows leave by doc_id and text digest. Where a doc_id repeats, its rows are matched by digest and length, and one
    of those that are fully alike stays.
    """
    found = materialize(exact_duplicates(docs, text, doc_id), "duplicates")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id")
    gone = found.filter("not kept").select(F.col("doc_id").alias("__gone"))
    if repeated.isEmpty():
        return docs.join(sized(gone), docs[doc_id] == F.col("__gone"), "left_anti")
    repeated = materialize(repeated.withColumnRenamed("doc_id", "__gone"), "repeated")
    single = docs.join(sized(gone.unionByName(repeated)), docs[doc_id].eqNullSafe(F.col("__gone")), "left_anti")
    some = docs.join(sized(repeated), docs[doc_id].eqNullSafe(F.col("__gone")), "left_semi")
    body = F.coalesce(F.col(text), F.lit(""))
    some = some.withColumns({"__sha": F.sha2(F.translate(body, _BLANK.decode(), ""), 256), "__n": F.length(body).cast("long")})
    keep = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__s"), F.col("n_points").alias("__p"))
    kept = some.join(keep, some[doc_id].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__s")) & (F.col("__n") == F.col("__p")), "left_semi")
    return single.unionByName(kept.dropDuplicates([doc_id, "__sha", "__n"]).drop("__sha", "__n"))
