"""Exact percentiles and modes without one task that holds a column's values."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.stable import spread, written


#: Size of the sketches: ranks are off by some 0.1 % of the values. Values that go to the driver for all ranks at most.
SKETCH, FEW = 2_000, 100_000
#: How far, as a share of the values, bounds are put from a rank on either side.
MARGIN = 0.002


@dataclass
class _Target:
    """Neighbouring ranks of a column between two bounds; `below` values are less than `low`, `upto` are `high` at most."""

    column: str
    rank: int
    last: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    upto: int = 0
    stuck: bool = False

    @property
    def inside(self) -> int:
        return 0 if self.low == self.high else self.upto - self.below


def _narrow(df: DataFrame, x: dict[str, Column], open_: list[_Target]) -> None:
    """Put the bounds of all targets closer: a sketch of the values between them, then exact counts in a second pass.

    Sketches only propose bounds; a bound that the counts don't confirm stays where it was.
    """
    spans = {(t.column, t.low, t.high): None for t in open_}
    names = {span: f"s{i}" for i, span in enumerate(spans)}
    sketches = df.agg(*[F.kll_sketch_agg_double(F.when((x[c] >= low) & (x[c] <= high), x[c]), F.lit(SKETCH)).alias(name) for (c, low, high), name in names.items()])
    places = [[min(max((t.rank - t.below + 0.5) / max(t.upto - t.below, 1) + d, 0.0), 1.0) for d in (-MARGIN, MARGIN)] for t in open_]
    proposed = sketches.select(*[F.kll_sketch_get_quantile_double(names[t.column, t.low, t.high], F.array(*[F.lit(p) for p in at])).alias(f"q{i}") for i, (t, at) in enumerate(zip(open_, places, strict=True))]).first()
    bounds = [tuple(proposed[f"q{i}"]) for i in range(len(open_))]
    counts = df.agg(
        *[F.count(F.when(x[t.column] < low, 1)).alias(f"b{i}") for i, (t, (low, _)) in enumerate(zip(open_, bounds, strict=True))],
        *[F.count(F.when(x[t.column] <= high, 1)).alias(f"u{i}") for i, (t, (_, high)) in enumerate(zip(open_, bounds, strict=True))],
    ).first()
    for i, (t, (low, high)) in enumerate(zip(open_, bounds, strict=True)):
        before = t.inside
        if counts[f"b{i}"] <= t.rank and low >= t.low:
            t.low, t.below = low, counts[f"b{i}"]
        if counts[f"u{i}"] > t.last and high <= t.high:
            t.high, t.upto = high, counts[f"u{i}"]
        t.stuck = 2 * t.inside > before


def quantiles(df: DataFrame, wanted: dict[str, list[float]], values: dict[str, Column] | None = None) -> dict[tuple[str, float], float | None]:
    """Exact percentiles, interpolated between neighbours, of several columns (or of `values` by their names).

    Mergeable sketches give bounds on each rank, exact counts confirm them, and what lies between two bounds goes to the
    driver once that is FEW values in all. Only where values repeat so much that bounds don't come closer are the
    distinct values dealt by ranges and written. Nulls, NaN and infinities don't count; a column without values has null
    percentiles. df is read three times as a rule: give it written, if it is costly.
    """
    names = list(wanted)
    if not names:
        return {}
    number = {c: (values or {}).get(c, F.col(c)).cast("double") for c in names}
    x = {f"x{i}": F.col(f"x{i}") for i in range(len(names))}
    table = df.select(*[F.when(~F.isnan(number[c]) & (F.abs(number[c]) != math.inf), number[c]).alias(k) for k, c in zip(x, names, strict=True)])
    totals = table.agg(*[F.count(k).alias(k) for k in x]).first()
    places = {(k, p): p * (totals[k] - 1) for k, c in zip(x, names, strict=True) for p in wanted[c] if totals[k]}
    targets = [_Target(k, math.floor(place), math.ceil(place), upto=totals[k]) for (k, _), place in places.items()]
    while open_ := [t for t in targets if t.inside > FEW // len(targets) and not t.stuck]:
        _narrow(table, x, open_)
    found = {(t.column, rank): t.low for t in targets if t.low == t.high for rank in (t.rank, t.last)}
    few = [t for t in targets if t.low != t.high and not t.stuck]
    if few:
        near = [(x[t.column] >= t.low) & (x[t.column] <= t.high) for t in few]
        cells = F.array(*[F.when(inside, F.struct(F.lit(i).alias("t"), x[t.column].alias("x"))) for i, (t, inside) in enumerate(zip(few, near, strict=True))])
        counted = table.filter(reduce(or_, near)).select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.t", "c.x").agg(F.count(F.lit(1)).alias("n"))
        up = {i: t.below for i, t in enumerate(few)}
        for r in sorted(counted.collect()):  # FEW at most
            t = few[r["t"]]
            found |= {(t.column, rank): r["x"] for rank in (t.rank, t.last) if up[r["t"]] <= rank < up[r["t"]] + r["n"]}
            up[r["t"]] += r["n"]
    if rest := {(t.column, rank) for t in targets for rank in (t.rank, t.last) if (t.column, rank) not in found}:
        found |= _from_ranges(table, {k: sorted(rank for c, rank in rest if c == k) for k, _ in rest})
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in names for p in wanted[c]}
    for (k, p), place in places.items():
        low, high = math.floor(place), math.ceil(place)
        a, b = found[k, low], found[k, high]
        out[names[int(k[1:])], p] = a if low == high or a == b else (high - place) * a + (place - low) * b
    return out


def _from_ranges(table: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Values of some ranks. Distinct values are counted (combined before the shuffle) and dealt by ranges, which are written.

    Each range's row count, one number for each range and column, tells in which range a rank lies; only those ranges are
    summed up.
    """
    names = list(ranks)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("x")) for k, c in enumerate(names)])).alias("p")
    counted = spread(table, len(names)).select(pairs).select("p.*").filter("x is not null").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    with written(counted.repartitionByRange("k", "x").withColumn("part", F.spark_partition_id())) as ranged:
        held, at = {}, {}
        for r in sorted(ranged.groupBy("k", "part").agg(F.sum("n").alias("n")).collect()):
            start = held.get(r["k"], 0)
            at |= {(r["k"], rank): (r["part"], start) for rank in ranks[names[r["k"]]] if start <= rank < start + r["n"]}
            held[r["k"]] = start + r["n"]
        needed = df_of(table, sorted({(k, part, start) for (k, _), (part, start) in at.items()}))
        up = F.sum("n").over(Window.partitionBy("k", "part").orderBy("x")) + F.col("start")
        some = ranged.join(F.broadcast(needed), ["k", "part"]).withColumn("up", up)  # a range for each rank at most
        row = some.agg(*[F.min(F.when((F.col("k") == k) & (F.col("part") == part) & (F.col("up") > rank), F.col("x"))).alias(f"{k}|{rank}") for (k, rank), (part, _) in at.items()]).first()
    return {(names[k], rank): row[f"{k}|{rank}"] for k, rank in at}


def df_of(table: DataFrame, rows: list[tuple[int, int, int]]) -> DataFrame:
    return table.sparkSession.createDataFrame(rows, "k int, part int, start long")


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """The most frequent value of each column, the smallest of ties; null without values."""
    out = {}
    for c in columns:
        counted = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        best = counted.agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best")).first()["best"]
        out[c] = best["value"] if best else None
    return out
