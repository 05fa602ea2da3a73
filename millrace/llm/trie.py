"""A trie of conversation prefixes, by partition refinement.

All conversations start in one class, the root. Each turn splits the active classes by what their members say next; a
class left with one conversation is retired, and the rest of that conversation is emitted as a unary chain without
looking at it again. Turns are refined in blocks that grow (BLOCKS): inside of a block the class of each turn is the
digest of the class before and the turn itself, chained over sorted rows, so that one round of Spark jobs splits many
turns. A conversation's rows stay in one task for one block at most. Folding back runs over the blocks from the last to
the first: leaves and saved tokens are credited to the smallest member of their node, added up from each conversation's
last turn towards the root, and then summed for each class.

Only counts go through the driver. Classes are counted with partial sums before the shuffle; parents are joined by a
sort-merge join, whose skew adaptive execution splits. The ids that end at one node are hashed as a stream, in order:
one node's ids pass through one task, 8 bytes each, without being held.

Defined results: rows without a conversation id belong to no conversation. Null turns come first, rows of one turn are
in order of their contents' digest; null roles and texts count as empty. Repeated rows are turns of their own. A
conversation without turns ends at the root. An empty table has no nodes. Other columns are not touched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, materialize

#: Turns of the first block, how much longer each next one is, and the longest.
BLOCKS = (4, 4, 1 << 16)
ROOT = b"\0" * 16


def content(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn's role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, tokens) with 0-based places in each conversation, and (conv_id, n_turns).

    Rows are dealt by ranges of (conv_id, turn, key) and written; a conversation may span ranges, and each range's
    offset in it comes from a small table of (conversation, range) counts.
    """
    ranged = materialize(rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "key").withColumn("at", F.monotonically_increasing_id()).drop("turn"), "turns")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    pieces = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("start", before - F.col("first"))
    placed = ranged.join(pieces.select("conv_id", "part", "start"), ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("start"))
    return placed.select("conv_id", "pos", "key", "tokens"), pieces.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["conv_id"].to_pylist()
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array([zlib.crc32(str(i).encode()) for i in ids], pa.int64())], ["conv_id", "crc"])


def rebuild(turns: DataFrame, sizes: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first crc32(id) % `most` turns of every `every`-th one, in place of their own."""
    donor = F.col("conv_id") - F.col("conv_id") % every
    heads = map_arrow(sizes.select("conv_id"), _crc, "conv_id long, crc long").select("conv_id", (F.col("crc") % most).alias("head"))
    taken = sizes.select(F.col("conv_id").alias("donor"), F.least("n_turns", F.lit(most - 1)).alias("lent"))
    plan = sizes.join(heads, "conv_id").withColumn("donor", donor).join(taken, "donor", "left")
    plan = plan.select("conv_id", "donor", "head", F.least("head", F.coalesce("lent", F.lit(0))).alias("lent"), F.greatest(F.col("n_turns") - F.col("head"), F.lit(0)).alias("own"))
    plan = materialize(plan, "plan")
    lent = turns.filter(((F.col("conv_id") % every) == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "donor")
    first = plan.filter("lent > 0").join(lent, "donor").filter("pos < lent").select("conv_id", "pos", "key", "tokens")
    rest = turns.join(plan, "conv_id").filter("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("lent")).alias("pos"), "key", "tokens")
    return first.unionByName(rest), plan.select("conv_id", (F.col("lent") + F.col("own")).alias("n_turns"))


# -- refinement ------------------------------------------------------------------------------------------------


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes along rows that are sorted by (conv_id, pos); each conversation starts from its class before the block."""
    conv, held = None, ROOT
    for batch in batches:
        parents, classes = [], []
        for c, key, start in zip(batch["conv_id"].to_pylist(), batch["key"].to_pylist(), batch["class"].to_pylist(), strict=True):
            if c != conv:
                conv, held = c, start
            parents.append(held)
            held = hashlib.blake2b(held + key, digest_size=16).digest()
            classes.append(held)
        depth = pc.add(batch["pos"], 1)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], depth, pa.array(parents, pa.binary()), pa.array(classes, pa.binary()), batch["tokens"], batch["n_turns"]], ["conv_id", "depth", "parent", "class", "tokens", "n_turns"])


_ROW = "conv_id long, depth long, parent binary, class binary, tokens long, n_turns long"


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each class: its smallest member, sizes, and what its node says."""
    ends = F.col("n_turns") == F.col("depth")
    found = rows.groupBy("depth", "class").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("tokens").alias("tokens"),
        F.count(F.when(ends, 1)).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("end_id"), F.max("n_turns").alias("longest"),
    )
    return found


def refine(turns: DataFrame, sizes: DataFrame, blocks: tuple[int, int, int] = BLOCKS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of rows (a member's turn with its class) and of classes, one of each for each block of turns."""
    active = sizes.filter("n_turns > 0").select("conv_id", "n_turns", F.lit(ROOT).alias("class"))
    start, size, rows, nodes = 0, blocks[0], [], []
    while not active.isEmpty():
        block = turns.filter((F.col("pos") >= start) & (F.col("pos") < start + size)).join(active, "conv_id")
        chained = map_arrow(block.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), _chain, _ROW)
        rows.append(materialize(chained, "rows"))
        nodes.append(materialize(classes_of(rows[-1]), "nodes"))
        start, size = start + size, min(size * blocks[1], blocks[2])
        # A class of one conversation retires: the conversation is its smallest member.
        alone = nodes[-1].filter((F.col("depth") == start) & (F.col("n_convs") == 1)).select("conv_id")
        going = rows[-1].filter((F.col("depth") == start) & (F.col("n_turns") > start)).select("conv_id", "n_turns", "class")
        active = materialize(going.join(alone, "conv_id", "left_anti"), "active")
    return rows, nodes


# -- folding back ----------------------------------------------------------------------------------------------


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves and saved tokens from each turn on, along rows sorted by (conv_id, depth descending)."""
    conv, leaves, saved = None, 0, 0
    for batch in batches:
        out_leaves, out_saved = [], []
        for c, leaf, value, more_leaves, more_saved in zip(*(batch[x].to_pylist() for x in ("conv_id", "leaf", "value", "leaves", "saved")), strict=True):
            if c != conv:
                conv, leaves, saved = c, more_leaves, more_saved
            leaves, saved = leaves + leaf, saved + value
            out_leaves.append(leaves)
            out_saved.append(saved)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["depth"], batch["class"], pa.array(out_leaves, pa.int64()), pa.array(out_saved, pa.int64())], ["conv_id", "depth", "class", "leaves", "saved"])


def fold(rows: list[DataFrame], nodes: list[DataFrame]) -> tuple[list[DataFrame], DataFrame | None]:
    """(depth, class, n_leaves, saved_tokens) of each block's classes, and what each conversation carries to the root."""
    carried, sums = None, []
    for k in range(len(rows) - 1, -1, -1):
        own = nodes[k].select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("tokens")).alias("value"), ((F.col("n_ends") == F.col("n_convs")) | (F.col("n_convs") == 1)).alias("childless"))
        # A conversation stands for a leaf if it is the smallest member of the childless class in which it ends or retires.
        marked = rows[k].join(own, ["conv_id", "depth"], "left")
        last = F.max("depth").over(Window.partitionBy("conv_id"))
        leaf = (F.coalesce("childless", F.lit(False)) & (F.col("depth") == last)).cast("long")
        marked = marked.select("conv_id", "depth", "class", leaf.alias("leaf"), F.coalesce("value", F.lit(0)).alias("value"))
        if carried is None:
            marked = marked.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            marked = marked.join(carried, "conv_id", "left").fillna(0, ["leaves", "saved"])
        sorted_rows = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("depth").desc())
        summed = materialize(map_arrow(sorted_rows, _suffix, "conv_id long, depth long, class binary, leaves long, saved long"), "suffix")
        sums.append(summed.groupBy("depth", "class").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
        first = F.struct("depth", "leaves", "saved")
        carried = summed.groupBy("conv_id").agg(F.min(first).alias("first")).select("conv_id", "first.leaves", "first.saved")
    return sums[::-1], carried


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's ids, comma-joined, along rows sorted by (class, conv_id)."""
    at, running, out = None, None, []
    for batch in batches:
        for node, c in zip(batch["class"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    out.append((at, running.hexdigest()))
                at, running = node, hashlib.sha256(str(c).encode())
            else:
                running.update(f",{c}".encode())
        if len(out) > 10_000:
            yield _digests(out)
            out = []
    if at is not None:
        out.append((at, running.hexdigest()))
    yield _digests(out)


def _digests(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["class", "digest"])


def build(conversations: DataFrame, every: int = 20, most: int = 4, blocks: tuple[int, int, int] = BLOCKS) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 of the trie of rebuilt conversations."""
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content(F.col("role"), F.col("text")).alias("key"), n_words(F.col("text")).alias("tokens"))
    turns, sizes = numbered(narrow)
    turns, sizes = rebuild(turns, sizes, every, most)
    turns = materialize(turns, "rebuilt")
    rows, nodes = refine(turns, sizes, blocks)
    sums, carried = fold(rows, nodes)
    empty = F.col("n_turns") == 0
    top = sizes.withColumns({"depth": F.lit(0).cast("long"), "class": F.lit(ROOT), "parent": F.lit(None).cast("binary"), "tokens": F.lit(0).cast("long")})
    inner = [n.join(s, ["depth", "class"]) for n, s in zip(nodes, sums, strict=True)]
    root = classes_of(top).filter("conv_id is not null")
    total = carried.agg(F.sum("leaves"), F.sum("saved")).first() if carried is not None else (None, None)
    # With nothing below the root, it is a leaf itself.
    root = root.withColumns({"n_leaves": F.lit(total[0] or 1).cast("long"), "saved_tokens": F.lit(total[1] or 0).cast("long")})
    found = root
    for x in inner:
        found = found.unionByName(x)
    found = materialize(found, "classes")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("class")).agg(F.count(F.lit(1)).alias("more"))
    several = sizes.filter(empty).select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("class"), "conv_id")
    for r in rows:
        several = several.unionByName(r.filter("n_turns = depth").select("depth", "class", "conv_id"))
    # Depth is part of a class's digest chain, so that classes alone name nodes.
    shared = several.join(found.filter("n_ends > 1").select("class"), "class", "left_semi") if rows else several
    digests = map_arrow(shared.select("class", "conv_id").repartition("class").sortWithinPartitions("class", "conv_id"), _digest, "class binary, digest string")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("class").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kids = F.when((F.col("n_convs") == 1) & (F.col("longest") > F.col("depth")), 1).otherwise(F.coalesce("more", F.lit(0))).cast("long")
    ended = F.when(F.col("n_ends") == 1, F.sha2(F.col("end_id").cast("string"), 256)).otherwise(F.coalesce("digest", F.sha2(F.lit(""), 256)))
    full = found.join(children, ["depth", "class"], "left").join(parents.hint("merge"), ["depth", "parent"], "left").join(digests, "class", "left")
    known = full.select("conv_id", "depth", "parent_conv_id", "n_convs", kids.alias("n_children"), "n_leaves", "saved_tokens", ended.alias("ends_sha256"))
    # What a retired conversation says beyond the block in which it became a class of its own.
    seen = None
    for r in rows:
        deepest = r.groupBy("conv_id").agg(F.max("depth").alias("deepest"))
        seen = deepest if seen is None else seen.unionByName(deepest)
    if seen is None:
        return known
    seen = seen.groupBy("conv_id").agg(F.max("deepest").alias("deepest"))
    tail = turns.join(sizes, "conv_id").join(seen, "conv_id").filter("pos >= deepest")
    end = F.col("n_turns") == F.col("pos") + 1
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = tail.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return known.unionByName(chain)
