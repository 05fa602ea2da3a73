"""Mixing sources to target weights by pivotal dependent rounding.

Every source's target (in words) is a fractional number of copies of each of its documents: the whole part is certain,
the fraction is a probability. The pivotal method settles two documents at a time: mass moves from one to the other,
in words so that the source's total stays exact, in the direction and amount that make one of them integral, with
odds that keep each document's expectation. What is left open of a chunk (one document at most) goes up a reduction
tree of bounded fan-in, where open documents of the same source meet again; a lone last one is rounded by its odds.

A source's taken words thus differ from its target by less than one document. Chunks, order and random numbers depend
on document ids, texts (by size and a checksum) and a seed only, so that reruns agree. A hot source is many chunks, never one task.

Defined results: a null text has size 0. A null source is a source of its own, last in order. Documents of size 0 take
nothing. Repeated rows and ids are rows of their own. An empty table gives an empty result. Other columns stay away.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import encoded, map_arrow, materialize, rank_rows, sized

#: Documents of one source that a task settles in one go, and chunks whose open documents meet at the next level.
CHUNK_ROWS, FAN_IN = 500, 64
_FIELDS = ["uid", "doc_id", "source", "size", "mark", "base", "p", "key", "chunk"]
_SCHEMA = "uid long, doc_id long, source string, size long, mark long, base long, p double, key long, chunk long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = encoded(batch["text"])
        sizes, marks = pa.array([len(t.split()) for t in raw], pa.int64()), pa.array([zlib.crc32(t) for t in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["uid"], batch["doc_id"], batch["source"], sizes, marks], ["uid", "doc_id", "source", "size", "mark"])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, get the weights in turn and share `share` of all sizes; a target stops at
    `most` times its source's size, and the excess goes to the others by weight until none is above. Each round is
    one small aggregate; the driver holds sums only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_rows(totals, F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    cap, level, n_capped = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:  # the level only rises, so every round caps more sources or is the last
        full = F.lit(level) * F.col("weight") > cap if n_capped >= 0 else F.lit(False)
        n, taken, weight = ranked.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == n_capped or not weight:
            break
        level, n_capped = (total - taken) / weight, n
    target = F.least(F.lit(level) * F.col("weight"), cap) if n_capped >= 0 else cap
    return ranked.select("source", "source_size", F.when(F.lit(bool(weight)), target).otherwise(cap).alias("target"))


def _uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the seed and two row keys only (splitmix64)."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & (2**64 - 1)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * mult) & (2**64 - 1)
    return ((x ^ (x >> 31)) >> 11) / 2**53


def settle(size: list[int], p: list[float], key: list[int], seed: int) -> tuple[list[float], int]:
    """Pivotal rounding along a list: probabilities with one fractional at most, and its index (or -1).

    Mass moves in words: size[i] * p[i] + size[j] * p[j] stays the same in each step.
    """
    p, open_at = list(p), -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up, down = min(size[i] * (1 - p[i]), size[j] * p[j]), min(size[i] * p[i], size[j] * (1 - p[j]))
        if _uniform(seed, key[i], key[j]) * (up + down) < down:
            move = up
        else:
            move = -down
        ends = {i: p[i] + move / size[i], j: p[j] - move / size[j]}
        for k, v in ends.items():  # the one that has reached its end is set to it exactly
            p[k] = 0.0 if v < 1e-12 else 1.0 if v > 1 - 1e-12 else v
        open_at = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p, open_at


def _level(seed: int, last: bool) -> Callable:
    """Settle one chunk of one source; at the last level also the document that stays open."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort([group[c].to_numpy() for c in ("mark", "size", "key")])
        group = group.take(pa.array(order))
        key = group["key"].to_pylist()
        p, open_at = settle(group["size"].to_pylist(), group["p"].to_pylist(), key, seed)
        if last and open_at >= 0:
            p[open_at] = float(_uniform(seed + 1, key[open_at], 0) < p[open_at])
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def _mixed(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 17) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, copies, taken of rows (uid, doc_id, source, text)."""
    sizes = materialize(map_arrow(rows, _word_counts, "uid long, doc_id long, source string, size long, mark long"), "sizes")
    goals = materialize(targets(sizes, weights, share, most), "targets")
    rows = sizes.join(sized(goals), sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", copies).withColumn("base", F.floor("copies"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("copies") - F.col("base")).otherwise(0.0)).withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    biggest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    chunks = max(1, math.ceil(biggest / CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "size", "mark"), F.lit(chunks)))
    done, level = None, 0
    rows = rows.select(*_FIELDS)
    while True:
        last = chunks == 1
        out = materialize(rows.groupBy("source", "chunk").applyInArrow(_level(seed + 2 * level, last), _SCHEMA), "settled")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        settled = out.filter(~still)
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        chunks, level = math.ceil(chunks / FAN_IN), level + 1
        rows = out.filter(still).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
    copies = F.col("base") + F.col("p").cast("long")
    done = done.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))
    out = done.join(sized(goals), done["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    options: weights, share, most and seed, as in targets().
    """
    rows = docs.select(F.lit(0).cast("long").alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return _mixed(rows, **options).drop("uid")


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns as they are.

    The rows are written with a number first, by which each gets just its own copies, however often its id occurs.
    """
    body = [F.col(c).alias(f"__{k}") for k, c in enumerate(docs.columns)]
    numbered = materialize(docs.select(*body).withColumn("__uid", F.monotonically_increasing_id()), "numbered")
    at = {c: f"__{docs.columns.index(c)}" for c in (text, source, doc_id)}
    rows = numbered.select(F.col("__uid").alias("uid"), F.col(at[doc_id]).cast("long").alias("doc_id"), F.col(at[source]).cast("string").alias("source"), F.col(at[text]).alias("text"))
    other = materialize(_mixed(rows, **options).filter("copies != 1").select(F.col("uid").alias("__uid"), F.col("copies").cast("int").alias("__copies")), "copies")
    out = numbered.join(sized(other), "__uid", "left").withColumn("__copies", F.coalesce("__copies", F.lit(1))).filter("__copies > 0")
    # A row is repeated without any shuffle, by exploding a bounded array of its copies.
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])
