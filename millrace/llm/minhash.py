"""MinHash near-duplicates: universal-hash minima, banding, signature checks, exact confirmation, star contraction.

A document's set is its distinct shingles (word n-grams over A-Z lower-cased words; the whole sequence if it has
fewer words). Documents are linked when intersection / union reaches the threshold, and components follow links.

1. Each text gives its set's size, a 128-bit digest of the set, and K minima of 2-universal multiply-shift hashes.
2. Rows with equal sets collapse to one node, so groups of copies cost one node.
3. Nodes share a bucket when all minima of a band agree. A bucket is never expanded into pairs: each member is
   compared with the bucket's hub only, and hubs differ from band to band, as nodes are ordered by a hash of their own
   for each band. Members are dealt in slices of a bucket, each with the hub, so a large bucket is many tasks'
   work. Candidates are checked by their signatures, then confirmed on the full sets.
4. Alternating large-star and small-star contracts the confirmed links to components.
5. Buckets that still hold several components are compared completely, in blocks of bounded size, leaving out pairs
   that are connected already or that an earlier band has compared. Pairs never become rows: a block passes on the
   members that have a candidate, then, with their full sets, a forest of confirmed links; and 4 runs again. A
   member of a bucket of n such nodes is read n / BLOCK times.

Bands are cut so that a pair at the threshold shares no bucket with a probability of 1e-6 at most: 32 bands of 6 minima
for 0.85, 38 of 5 for 0.8.

Defined results: null, empty or blank texts have the empty set (n_shingles 0) and are linked with nothing. Rows are
linked by their texts alone, so rows of one doc_id with different texts may be in different components. Rows with a
null doc_id are linked like any other; a component is named by its smallest id, and is null if it has none, when just
one of its rows is kept. Repeated rows have equal sets and thus one component. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize, mix, sized, slices, word_hashes

#: Minima of a signature, and how often a pair right at the threshold may share no bucket.
MINIMA, MISSED = 192, 1e-6
#: How many standard errors a signature's estimate may be below the threshold.
ERRORS = 4.5
#: Members of a bucket that one block of the complete comparison holds, and members that meet their hub in one slice.
BLOCK, SLICE = 2048, 2000


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) of MINIMA: the most rows for which a pair at the threshold is missed no more often than MISSED."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISSED]
    rows = max(fits, default=1)
    return MINIMA // rows, rows


def universal(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of k 2-universal multiply-shift hashes from 32 to 32 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, k, dtype=np.uint64), rng.integers(0, 2**64, k, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, bounds = word_hashes(data, offsets)
    odd = np.uint64(0x9E3779B97F4A7C15)
    value = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        value = mix(value * odd + words[k : k + len(value)])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(value[a : b - size + 1]))
        elif b > a:  # fewer words: the whole sequence, apart from all full shingles
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * odd + w)
            sets.append(h)
        else:
            sets.append(value[:0])
    return sets


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The k minima, as uint32; in pieces, so that scratch memory stays bounded for any text."""
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    x = shingles >> np.uint64(32)
    for i in range(0, len(x), 1024):
        h = x[None, i : i + 1024] * mult[:, None]
        h += add[:, None]
        np.minimum(low, (h.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=low)
    return low


def _sign(size: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = universal(k)
        for batch in batches:
            for i, j, data, offsets in slices(batch["text"]):
                sets = shingle_sets(data, offsets, size)
                d1, d2 = zip(*map(digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([signature(s, mult, add).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _bands(bands: int, rows: int) -> Callable:
    """(bucket, band, node, order) for each band of each node's signature; order is the node's place in hub elections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.array(batch["node"], np.int64)
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(len(node), bands, rows)
            bucket = np.repeat(salt[None, :], len(node), 0)
            for r in range(rows):
                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            order = mix(node.view(np.uint64)[:, None] ^ salt[None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(node))), pa.array(np.repeat(node, bands)), pa.array(order.ravel().view(np.int64))],
                ["bucket", "band", "node", "order"],
            )

    return run


def _alike(k: int, least: float) -> Callable:
    """Of rows (a, b, sig_a, sig_b): the pairs whose signatures agree in at least that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(-1, k) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    mixed = mix(shingles)
    return int(np.bitwise_xor.reduce(mixed).view(np.int64)), int(np.add.reduce(mix(mixed + np.uint64(1))).view(np.int64))


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch["text"]):
                sets = [s for s in shingle_sets(data, offsets, size) if len(s)]
                if sets:
                    d1, d2 = zip(*map(digest, sets), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["d1", "d2", "shingles"])

    return run


def _candidates(group: pa.Table, bands: int, rows: int, least: float, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of two blocks of one bucket (or within one) that are worth an exact comparison.

    They lie in different components, their signatures agree enough, and no earlier band has them in one bucket, so
    that each pair is looked at once over all buckets.
    """
    node, comp, side = (np.array(group[c]) for c in ("node", "component", "block"))
    band = group["band"][0].as_py()
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, bands, rows)
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    for i in left:
        other = right[(comp[right] != comp[i]) & ((node[right] > node[i]) | (low != high))]
        if len(other):
            same = sig[other] == sig[i]
            other = other[(same.mean(axis=(1, 2)) >= least) & ~same[:, :band].all(axis=2).any(axis=1)]
        if len(other):
            yield int(i), other


def _active(bands: int, rows: int, least: float) -> Callable:
    """The rows of two blocks that have a candidate: at most all of them, however many pairs they make."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        found = np.zeros(group.num_rows, bool)
        for i, other in _candidates(group, bands, rows, least, key[1].as_py(), key[2].as_py()):
            found[i] = True
            found[other] = True
        return group.select(["bucket", "low", "high", "band", "node", "component", "block"]).filter(pa.array(found))

    return run


def _forest(bands: int, rows: int, least: float, percent: int) -> Callable:
    """Links of two blocks, confirmed on full sets, that join components: fewer than there are rows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, sets = group["node"].to_pylist(), [np.array(x, np.int64) for x in group["shingles"].to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        comp, a, b = group["component"].to_pylist(), [], []
        for i, others in _candidates(group, bands, rows, least, key[1].as_py(), key[2].as_py()):
            for j in others.tolist():
                if (x := find(comp[i])) != (y := find(comp[j])):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        root[max(x, y)] = min(x, y)
                        a.append(node[i])
                        b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def full_sets(nodes: DataFrame, docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of some nodes, read from the texts of their representatives' ids alone."""
    asked = materialize(nodes.select("node").distinct().join(reps, "node"), "asked")
    ids = sized(materialize(asked.select(F.col("doc_id").alias("__rep")).distinct(), "ids"))
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__rep")), "left_semi").select("text")
    sets = map_arrow(rows, _sets(size), "d1 long, d2 long, shingles array<long>").dropDuplicates(["d1", "d2"])
    return materialize(sets.join(asked, ["d1", "d2"]).select("node", "shingles"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, reps, size)
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes, component being the smallest node, by alternating star operations.

    links: (a, b) in any direction. Minima are combined before each shuffle, so that a hub's many links never meet
    in one task; every round is a table in the shared folder.
    """
    pairs = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total(pairs)
    while True:
        # Large star: every larger neighbour, and the node itself, points to the smallest of the neighbourhood.
        both = pairs.union(pairs.select("v", "u"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(lows.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = materialize(large, "large")
        # Small star: every smaller neighbour, and the node itself, points to the smallest of them.
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = materialize(small.union(lows.select("u", F.col("m").alias("v"))).distinct(), "small")
        pairs, now = small, total(small)
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _named(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have a set, with their node; and (node, d1, d2, smallest doc_id) of each node.

    A node is named by d1, or by a hash of both digests where different sets have the same d1.
    """
    rows = signed.filter("n_shingles > 0")
    reps = materialize(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")), "nodes")
    twice = materialize(reps.groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1").select("d1", F.lit(True).alias("twice")), "twice")
    if twice.isEmpty():
        return rows.withColumn("node", F.col("d1")), reps.withColumn("node", F.col("d1"))
    name = F.when(F.col("twice"), F.xxhash64("d1", "d2")).otherwise(F.col("d1"))
    rows, reps = (x.join(sized(twice), "d1", "left").withColumn("node", name).drop("twice") for x in (rows, reps))
    return rows, materialize(reps, "named")


def label_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, d1, d2, component_id, kept."""
    bands, rows = banding(percent)
    k, share = bands * rows, percent / 100
    least = share - ERRORS * (share * (1 - share) / k) ** 0.5
    signed = map_arrow(docs, _sign(shingle, k), "doc_id long, n_shingles long, d1 long, d2 long, sig binary")
    signed = materialize(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    named, reps = _named(signed)
    first = reps.select(F.col("node").alias("__node"), F.col("doc_id").alias("__rep"))
    sigs = named.join(first, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__rep")))
    sigs = materialize(sigs.select("node", "sig").dropDuplicates(["node"]), "signatures")

    banded = map_arrow(sigs, _bands(bands, rows), "bucket long, band int, node long, order long")
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("order", "node")).alias("low"), F.count("*").alias("n")).filter("n > 1")
    hubs = materialize(hubs.select("bucket", F.col("low.node").alias("hub"), "n"), "hubs")
    n_slices = F.ceil(F.col("n") / SLICE).cast("int")
    hot = materialize(hubs.filter(F.col("n") > SLICE).select("bucket", n_slices.alias("slices")), "hot")
    dealt = banded.drop("order").join(sized(hot), "bucket", "left").withColumn("slice", F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int"))
    hubs = hubs.withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1)))
    shared = materialize(dealt.join(hubs, ["bucket", "slice"]).select("bucket", "band", "node", "hub"), "buckets")
    pairs = shared.filter("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    x, y = (sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    alike = materialize(map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b"), _alike(k, least), "a long, b long"), "alike")
    links = confirm(alike, docs, reps, shingle, percent)
    found = materialize(components(links), "components")

    # Buckets whose members are not all connected yet: compare their components completely, in blocks.
    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n")).filter("c1 != c2")
    mixed = materialize(mixed.select("bucket", "n"), "unsettled")
    rest = materialize(placed.join(sized(mixed), "bucket").select("bucket", "band", "node", "component", "n"), "mixed")
    if not rest.isEmpty():
        n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
        cut = rest.select("bucket", "band", "node", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
        cut = cut.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "node", "component", "block")
        fields = "bucket long, low int, high int, band int, node long, component long, block int"
        active = materialize(cut.join(sigs, "node").groupBy("bucket", "low", "high").applyInArrow(_active(bands, rows, least), fields), "active")
        if not active.isEmpty():
            sets = full_sets(active, docs, reps, shingle)
            pairs = active.join(sigs, "node").join(sets, "node").groupBy("bucket", "low", "high")
            added = materialize(pairs.applyInArrow(_forest(bands, rows, least, percent), "a long, b long"), "added")
            if not added.isEmpty():
                stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
                found = materialize(components(stars.union(added)), "components")

    placed = materialize(reps.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    labels = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = materialize(placed.join(labels, "component").select("node", "component", "component_id"), "labels")
    linked = named.join(sized(label), "node").select("doc_id", "n_shingles", "d1", "d2", "component_id", "component", "uid")
    nameless = materialize(linked.filter("component_id is null").groupBy("component").agg(F.min("uid").alias("__uid")), "nameless")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if nameless.isEmpty():
        linked = linked.withColumn("kept", kept)
    else:  # components without any id keep their first row
        linked = linked.join(sized(nameless), "component", "left").withColumn("kept", F.when(F.col("component_id").isNull(), F.col("uid") == F.col("__uid")).otherwise(kept))
    alone = signed.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    out = ["doc_id", "n_shingles", "d1", "d2", "component_id", "kept"]
    return linked.select(*out).unionByName(alone.select(*out))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return label_rows(rows, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which doc_id is its component's smallest, with their columns as they are.

    A doc_id whose rows are in several components stays if it is the smallest of one of them. Of the rows of a component
    that has no doc_id at all, one stays.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = materialize(label_rows(rows, shingle, percent), "near")
    fate = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = materialize(fate.filter("not kept").select(F.col("doc_id").alias("__gone")), "gone")
    out = docs.join(sized(gone), docs[doc_id] == F.col("__gone"), "left_anti")
    if found.filter("doc_id is null and not kept").isEmpty():
        return out

    @F.arrow_udf("binary")
    def digests(column: pa.Array) -> pa.Array:
        sets = [s for _, _, data, offsets in slices(column) for s in shingle_sets(data, offsets, shingle)]
        return pa.array([np.array(digest(s), ">i8").tobytes() if len(s) else None for s in sets], pa.binary())

    stay = found.filter("doc_id is null and kept and n_shingles > 0").select(F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("d1", "d2")])).alias("__stay"))
    nameless = docs.filter(F.col(doc_id).isNull()).withColumn("__digest", digests(F.col(text)))
    one = nameless.join(stay, F.col("__digest") == F.col("__stay"), "left_semi").dropDuplicates(["__digest"])
    return out.filter(F.col(doc_id).isNotNull()).unionByName(one.unionByName(nameless.filter("__digest is null")).drop("__digest"))
