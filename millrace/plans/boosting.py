"""Boosted regression trees, as Spark's GBTRegressor grows them, of many fits at once.

GBTRegressor runs a job with a shuffle for each level of each tree of each fit, and adds up every feature of a row, those of
one-hot columns that are zero too. Here the rows of each fit are put into bins once, without the bins of zero, as blocks. Rows
walk down the newest tree, and counts and residuals are added up by node and bin. A fit of one block needs nothing else, and all
such fits are one job; for fits of several blocks, a job for each level adds up for all of them, and the driver chooses the
splits. Results are GBTRegressor's (squared error, all features), except that bounds of bins come from all rows, and that
splits which are equally good but for rounding may be chosen differently.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame

#: Rows of a block at most, by the counts that are given: a block is held by one task.
BLOCK_ROWS = 250_000
#: Distinct values of a feature that a partition reports; more are put together in groups of as many rows.
MOST_VALUES = 4_096
#: Histograms of one job that the driver adds up itself; more are added up on the executors first.
TO_DRIVER = 32 << 20
#: Bytes of predictions and nodes that a Python worker keeps between jobs. What it doesn't keep follows from the trees.
MOST_KEPT = 192 << 20
#: Trees that travel with each job; those before are broadcast.
RECENT = 10


@dataclass
class Bins:
    """The bins of all features, numbered through: values up to the first cut, to the second, ... and above the last."""

    cuts: list[np.ndarray]
    start: np.ndarray = field(init=False)
    zero: np.ndarray = field(init=False)
    size: int = field(init=False)

    def __post_init__(self) -> None:
        ends = np.cumsum([len(c) + 1 for c in self.cuts])
        self.start, self.size = np.r_[0, ends[:-1]], int(ends[-1])
        self.zero = self.start + [int(np.searchsorted(c, 0.0)) for c in self.cuts]


@dataclass
class Level:
    """A level's splits: bins from lo to mid go left, from mid to hi right, rows without a bin of the feature by default. Leaves go left."""

    lo: np.ndarray
    mid: np.ndarray
    hi: np.ndarray
    default: np.ndarray


@dataclass
class Tree:
    levels: list[Level] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))
    #: For each level: (n, sum, sum of squares) of its nodes, and the split's feature (-1: none), cut and gain.
    notes: list[tuple] = field(default_factory=list)
    grown: bool = False

    def mean(self) -> float:
        return float(self.notes[0][1][0] / max(self.notes[0][0][0], 1))

    def bare(self) -> tuple[list[Level], np.ndarray]:
        return self.levels, self.values


@dataclass
class Fit:
    """One boosting: its bins and trees, and the blocks of all fits that were made with it, until forget()."""

    estimator: GBTRegressor
    bins: Bins
    trees: list[Tree] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)  # of the rows that were held out
    number: int = 0
    blocks: RDD | None = None

    def weights(self) -> list[float]:
        return [1.0] + [self.estimator.getStepSize()] * (len(self.trees) - 1)


# -- rows to bins ------------------------------------------------------------------------------------------------


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of what vectors hold, by row."""
    import pyarrow.compute as pc  # workers don't load it otherwise

    column = column.storage if isinstance(column, pa.ExtensionArray) else column
    indices, values = pc.struct_field(column, "indices"), pc.struct_field(column, "values")
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = pc.is_valid(indices).to_numpy(zero_copy_only=False)
    feature[sparse[row]] = pc.list_flatten(indices).to_numpy(zero_copy_only=False)
    value = pc.list_flatten(values).to_numpy(zero_copy_only=False)
    some = value != 0
    return row[some], feature[some], value[some]


def _grouped(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; of too many, the largest of each group and the group's count."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(values))
    if len(values) <= MOST_VALUES:
        return values, counts
    group = ((np.cumsum(counts) - counts / 2) * (MOST_VALUES / counts.sum())).astype(np.int64)
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
    return values[last], np.add.reduceat(counts, np.r_[0, last[:-1] + 1])


def _by_feature(feature: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(feature, kind="stable")
    names, starts = np.unique(feature[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, starts[1:]))  # of no entries, there is an empty part without a name


def _both(a: dict[int, tuple], b: dict[int, tuple]) -> dict[int, tuple]:
    return a | {j: _grouped(*(np.r_[x, y] for x, y in zip(a[j], got, strict=True))) if j in a else got for j, got in b.items()}


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, seen = 0, {}
    for batch in batches:
        learn = batch.filter(pa.array(~batch.column("held").to_numpy(zero_copy_only=False)))
        n += len(learn)
        _, feature, value = _entries(learn.column("features"))
        feature, value = feature[~np.isnan(value)], value[~np.isnan(value)]
        seen = _both(seen, {j: _grouped(value[at], np.ones(len(at))) for j, at in _by_feature(feature)})
    yield pa.RecordBatch.from_pydict({"part": [pickle.dumps((n, seen))]}, schema=pa.schema([("part", pa.binary())]))


def _cuts(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Spark's bounds of bins: between all values, or where groups of as many rows end."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    stride, so_far, aim, out = counts.sum() / (most + 1), np.cumsum(counts), counts.sum() / (most + 1), []
    for i in range(len(between)):
        if abs(so_far[i] - aim) < abs(so_far[i + 1] - aim):
            out.append(between[i])
            aim += stride
    return np.array(out)


def _bins(df: DataFrame, bounds: list[int]) -> list[Bins]:
    """The bins for each number of bins: bounds between values of the rows that aren't held out."""
    width, full = _width(df), {}
    counted = df.mapInArrow(_count_values, "part binary").rdd.map(lambda r: pickle.loads(r[0]))
    n, seen = counted.treeReduce(lambda a, b: (a[0] + b[0], _both(a[1], b[1])))
    for j in range(width):
        values, counts = seen.get(j, (np.zeros(0), np.zeros(0)))
        full[j] = _grouped(np.r_[values, 0.0], np.r_[counts, n - counts.sum()]) if counts.sum() < n else (values, counts)
    return [Bins([_cuts(*full[j], min(b, n) - 1) for j in range(width)]) for b in bounds]


def _width(df: DataFrame) -> int:
    meta = df.schema["features"].metadata.get("ml_attr", {})
    return meta["num_attrs"] if "num_attrs" in meta else df.select("features").first()[0].size


def _block_maker(fits: list[tuple[int, Bins]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes a partition's block for each fit: (bins of each row that aren't the feature's bin of zero, label, rows to learn from, which come first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held, key, parts = [], [], [], {k: [] for k, _ in fits}
        for batch in batches:
            for name, to in (("label", label), ("held", held), ("key", key)):
                to.append(batch.column(name).to_numpy(zero_copy_only=False))
            row, feature, value = _entries(batch.column("features"))
            by_feature = list(_by_feature(feature))
            for k, bins in fits:
                code = np.empty(len(row), np.int32)
                for j, at in by_feature:
                    code[at] = bins.start[j] + np.searchsorted(bins.cuts[j], value[at])
                some = code != bins.zero[feature]
                r, c = row[some], code[some]
                sizes = np.bincount(r, minlength=len(batch))
                table = np.full((int(sizes.max(initial=0)), len(batch)), bins.size, np.int32)
                table[np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes), r] = c
                parts[k].append(table)
        if not label:
            return
        label, held, key = (np.concatenate(x) for x in (label, held, key))
        order = np.lexsort((key, held))
        for k, bins in fits:
            deep = max(len(x) for x in parts[k])
            table = np.concatenate([np.pad(x, ((0, deep - len(x)), (0, 0)), constant_values=bins.size) for x in parts.pop(k)], axis=1)
            block = pickle.dumps((np.ascontiguousarray(table[:, order]), label[order].astype(np.float64), int((~held).sum()), bins.size), protocol=5)
            yield pa.RecordBatch.from_pydict({"fit": [k], "block": [block]}, schema=pa.schema([("fit", pa.int32()), ("block", pa.large_binary())]))

    return run


def _named(run: bytes) -> Callable:
    """Blocks by fit, with what names them: the run and their content, as a block that is made again may hold rows in another order."""
    return lambda row: (row[0], hashlib.blake2b(row[1], digest_size=16, key=run).digest(), bytes(row[1]))


# -- growing -----------------------------------------------------------------------------------------------------


class _State:
    """A block's predictions by the trees so far, and each row's node in the next tree. Worked out anew where a worker has none."""

    def __init__(self, rows: int) -> None:
        self.trees = self.level = 0
        self.sums, self.node, self.residual = np.zeros(rows), np.zeros(rows, np.int64), None

    def walk(self, codes: np.ndarray, size: int, levels: list[Level]) -> None:
        while self.level < len(levels):
            at = levels[self.level]
            way = np.zeros((len(at.lo), size + 1), np.int8)
            for i in np.flatnonzero(at.hi):
                way[i, at.lo[i] : at.mid[i]], way[i, at.mid[i] : at.hi[i]] = 1, 2
            way, base = way.ravel(), self.node * (size + 1)
            goes = np.zeros(len(self.node), np.int8)
            for column in codes:
                np.maximum(goes, way[base + column], out=goes)
            self.node = 2 * self.node + np.where(goes == 0, at.default[self.node], goes - 1)
            self.level += 1

    def add(self, weight: float, values: np.ndarray) -> None:
        self.sums += weight * values[self.node]
        self.trees, self.level, self.residual = self.trees + 1, 0, None
        self.node = np.zeros(len(self.node), np.int64)


def _sums(state: _State, codes: np.ndarray, label: np.ndarray, learn: int, size: int, levels: list[Level]) -> list[np.ndarray]:
    """(n, sum, sum of squares) of the nodes below the levels, and (n, sum) of their bins but those of zero."""
    state.walk(codes, size, levels)
    if state.residual is None:  # the first tree learns the labels, the others the squared error's gradient
        state.residual = 2 * (label[:learn] - state.sums[:learn]) if state.trees else label[:learn]
    node, r, nodes = state.node[:learn], state.residual, 1 << len(levels)
    base = node * (size + 1)
    n, s = np.zeros(nodes * (size + 1)), np.zeros(nodes * (size + 1))
    for column in codes:
        at = base + column[:learn]
        n += np.bincount(at, minlength=len(n))
        s += np.bincount(at, weights=r, minlength=len(s))
    total = [np.bincount(node, weights=w, minlength=nodes) for w in (None, r, r * r)]
    return [np.stack(total).astype(np.float64), np.stack([n, s]).reshape(2, nodes, size + 1)[:, :, :size]]


def _held_out(state: _State, label: np.ndarray, learn: int, shift: float) -> list[np.ndarray]:
    """Sums over the rows held out, from which metrics follow."""
    y, p = label[learn:] - shift, state.sums[learn:] - shift
    return [np.array([len(y), y.sum(), (y * y).sum(), ((y - p) ** 2).sum(), np.abs(y - p).sum()])]


def _alone(fits: dict[int, tuple[Bins, int, int, float]]) -> Callable:
    """Grows all trees of fits of one block: (fit, trees, sums over the rows held out)."""

    def run(blocks: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, list[Tree], np.ndarray]]:
        for k, _, block in blocks:
            if k in fits:
                codes, label, learn, size = pickle.loads(block)
                state, trees, (bins, most, depth, step) = _State(len(label)), [], fits[k]
                for t in range(most):
                    trees.append(tree := Tree())
                    while not tree.grown:
                        _split(tree, bins, depth, *_sums(state, codes, label, learn, size, tree.levels))
                    state.walk(codes, size, tree.levels)
                    state.add(step if t else 1.0, tree.values)
                yield k, trees, _held_out(state, label, learn, trees[0].mean())[0]

    return run


_KEPT: OrderedDict[tuple, _State] = OrderedDict()


def _state(name: tuple, rows: int, most: tuple[int, int]) -> _State:
    """What is kept of a block, or its state before all trees; one that is further than the job's (trees, levels) is of no use."""
    state = _KEPT.pop(name, None)
    state = _State(rows) if state is None or (state.trees, state.level) > most else state
    _KEPT[name] = state
    while len(_KEPT) > 1 and sum(24 * len(x.sums) for x in _KEPT.values()) > MOST_KEPT:
        _KEPT.popitem(last=False)
    return state


def _step(done: Any, recent: list[dict], weights: dict[int, float], finish: dict[int, float] | None) -> Callable:
    """Walks a partition's blocks and adds up by fit. done: broadcast trees before the recent ones; the last one is the tree that grows.
    finish: the labels' shift of each fit; sums over the rows held out are wanted, all trees being grown."""

    def run(blocks: Iterator[tuple[int, bytes, bytes]]) -> Iterator[dict[int, list[np.ndarray]]]:
        out: dict[int, list[np.ndarray]] = {}
        before = len(recent) - (finish is None) + (done.of if done else 0)
        for k, digest, block in blocks:
            if k not in (finish if finish is not None else recent[-1]):
                continue
            codes, label, learn, size = pickle.loads(block)
            levels = [] if finish is not None else recent[-1][k][0]
            state = _state((k, digest), len(label), (before, len(levels)))
            while state.trees < before:
                i = state.trees - (done.of if done else 0)
                grown, values = (done.trees.value[state.trees] if i < 0 else recent[i]).get(k, ([], None))
                if values is None:  # it has fewer trees than others
                    break
                state.walk(codes, size, grown)
                state.add(1.0 if state.trees == 0 else weights[k], values)
            got = _held_out(state, label, learn, finish[k]) if finish is not None else _sums(state, codes, label, learn, size, levels)
            out[k] = [a + b for a, b in zip(out[k], got, strict=True)] if k in out else got
        yield out

    return run


@dataclass
class _Done:
    trees: Any
    of: int


def _add(a: dict, b: dict) -> dict:
    return {k: [x + y for x, y in zip(a[k], b[k], strict=True)] if k in a and k in b else a.get(k) or b[k] for k in {**a, **b}}


def _gather(blocks: RDD, step: Callable, expected: int) -> dict[int, list[np.ndarray]]:
    parts, out = blocks.mapPartitions(step), {}
    if blocks.getNumPartitions() * expected > TO_DRIVER:
        return parts.treeReduce(_add)
    for got in parts.collect():
        out = _add(out, got)
    return out


def _split(tree: Tree, bins: Bins, depth: int, total: np.ndarray, sums: np.ndarray) -> None:
    """Give the tree its next level: the split of largest gain of each node, the first of equal ones, as Spark's."""
    n, s, q = total
    if not n.sum():
        raise ValueError("no rows to learn from")
    sums = sums.copy()
    sums[:, :, bins.zero] = 0
    rest = total[:2, :, None] - np.add.reduceat(sums, bins.start, axis=2)
    sums[:, :, bins.zero] = np.where(rest[0] > 0.5, rest, 0.0)  # not the rounding of sums where no rows are left
    run = np.cumsum(sums, axis=2)
    starts = np.repeat(bins.start, np.diff(np.r_[bins.start, bins.size]))
    before = np.concatenate([np.zeros((2, len(n), 1)), run[:, :, :-1]], axis=2)[:, :, starts]
    left, ls = run - before
    right, rs = n[:, None] - left, s[:, None] - ls
    ends = np.r_[bins.start[1:], bins.size] - 1
    ok = (left > 0.5) & (right > 0.5)
    ok[:, ends] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, ls * ls / left + rs * rs / right - (s * s / n)[:, None], -np.inf)
    best = np.argmax(gain, axis=1)
    at = np.arange(len(n))
    gain = gain[at, best]
    some = gain > 1e-12 * q  # less is rounding
    feature = np.searchsorted(bins.start, best, side="right") - 1
    tree.notes.append((n, s, q, np.where(some, feature, -1), best - bins.start[feature], np.where(some, gain / np.maximum(n, 1), 0.0)))
    if not tree.levels and n[0]:
        tree.values = s / n
    if not some.any():
        tree.grown = True
        return
    pick = lambda x: np.where(some, x, 0).astype(np.int64)
    tree.levels.append(Level(pick(bins.start[feature]), pick(best + 1), pick(ends[feature] + 1), pick(bins.zero[feature] > best)))
    values = np.repeat(tree.values, 2)
    values[0::2][some], values[1::2][some] = (ls[at, best][some] / left[at, best][some]), (rs[at, best][some] / right[at, best][some])
    tree.values, tree.grown = values, len(tree.levels) == depth


def _by_levels(blocks: RDD, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Grows the fits' trees, level by level; returns the sums over the rows held out."""
    steps, done, start = {k: f.estimator.getStepSize() for k, f in fits.items()}, None, 0
    there = lambda i, only: {k: f.trees[i].bare() for k, f in only.items() if i < len(f.trees)}
    last = max(f.estimator.getMaxIter() for f in fits.values())
    for t in range(last):
        if t - start == RECENT:
            start, old = t, done
            done = _Done(blocks.context.broadcast([there(i, fits) for i in range(t)]), t)
            if old:
                old.trees.unpersist()
        for f in fits.values():
            if t < f.estimator.getMaxIter():
                f.trees.append(Tree())
        while growing := {k: f for k, f in fits.items() if len(f.trees) == t + 1 and not f.trees[t].grown}:
            recent = [*(there(i, fits) for i in range(start, t)), there(t, growing)]
            expected = sum(16 * f.bins.size << len(f.trees[t].levels) for f in growing.values())
            got = _gather(blocks, _step(done, recent, steps, None), expected)
            for k, f in growing.items():
                _split(f.trees[t], f.bins, f.estimator.getMaxDepth(), *got[k])
    shift = {k: f.trees[0].mean() for k, f in fits.items()}
    return {k: x[0] for k, x in _gather(blocks, _step(done, [there(i, fits) for i in range(start, last)], steps, shift), 0).items()}


def boost(tables: dict[Any, DataFrame], estimators: dict[str, GBTRegressor], rows: dict[Any, int]) -> dict[tuple[str, Any], Fit]:
    """A fit of each estimator on each table, with r2, rmse and mae of the rows held out.

    tables: features, label (a double), held (not learned from), key (a number that orders rows). rows: how many, about.
    """
    fits, parts, run, single = {}, [], uuid.uuid4().bytes, set()
    for name, df in tables.items():
        count = max(1, math.ceil(rows[name] / BLOCK_ROWS))
        df = df.coalesce(count)
        own = [Fit(e, b, number=len(fits) + i) for i, (e, b) in enumerate(zip(estimators.values(), _bins(df, [e.getMaxBins() for e in estimators.values()]), strict=True))]
        fits |= {f.number: f for f in own}
        single |= {f.number for f in own} if count == 1 else set()
        made = df.mapInArrow(_block_maker([(f.number, f.bins) for f in own]), "fit int, block binary")
        parts.append(made.rdd.map(_named(run)))
    blocks = next(iter(tables.values())).sparkSession.sparkContext.union(parts).persist(StorageLevel.MEMORY_AND_DISK)
    sums = {}
    tasks = {k: (fits[k].bins, fits[k].estimator.getMaxIter(), fits[k].estimator.getMaxDepth(), fits[k].estimator.getStepSize()) for k in single}
    for k, trees, held in blocks.mapPartitions(_alone(tasks)).collect() if single else []:
        fits[k].trees, sums[k] = trees, held
    if rest := {k: f for k, f in fits.items() if k not in single}:
        sums |= _by_levels(blocks, rest)
    for k, f in fits.items():
        f.blocks = blocks
        if k not in sums or not sums[k][0]:
            raise ValueError("no rows to learn from, or none held out")
        n, y, yy, squares, absolute = sums[k].tolist()
        around = yy - y * y / n
        f.metrics = {"r2": 1 - squares / around if around else float("nan"), "rmse": (squares / n) ** 0.5, "mae": absolute / n}
    return dict(zip(((e, name) for name in tables for e in estimators), fits.values(), strict=True))


def forget(fits: Iterable[Fit]) -> None:
    """Give the blocks' memory back."""
    for blocks in {id(f.blocks): f.blocks for f in fits}.values():
        blocks.unpersist()


# -- Spark's model -----------------------------------------------------------------------------------------------


def _leaf_sums(fit: int, trees: list[tuple], weights: list[float]) -> Callable:
    """Adds up each tree's leaves: n, sum and sum of squares of what the tree has learned from."""

    def run(blocks: Iterator[tuple[int, bytes, bytes]]) -> Iterator[list[np.ndarray]]:
        out = [np.zeros((3, len(values))) for _, values in trees]
        for k, _, block in blocks:
            if k == fit:
                codes, label, learn, size = pickle.loads(block)
                codes, label, state = codes[:, :learn], label[:learn], _State(learn)
                for i, (levels, values) in enumerate(trees):
                    r = 2 * (label - state.sums) if i else label
                    state.walk(codes, size, levels)
                    out[i] += [np.bincount(state.node, weights=w, minlength=len(values)) for w in (np.ones(learn), r, r * r)]
                    state.add(weights[i], values)
        yield out

    return run


def spark_model(fit: Fit) -> GBTRegressionModel:
    """The fit as a model of pyspark.ml."""
    context, weights = fit.blocks.context, fit.weights()
    found = fit.blocks.mapPartitions(_leaf_sums(fit.number, [t.bare() for t in fit.trees], weights))
    leaves = found.treeReduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    jvm, gateway = context._jvm, context._gateway
    ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def doubles(values: list[float]) -> Any:
        out = gateway.new_array(jvm.double, len(values))
        for i, x in enumerate(values):
            out[i] = float(x)
        return out

    def node(tree: Tree, sums: np.ndarray, level: int, i: int) -> Any:
        split = level < len(tree.levels) and tree.notes[level][3][i] >= 0
        n, s, q = (x[i] for x in tree.notes[level][:3]) if split else sums[:, i << (len(tree.levels) - level)]
        said = impurity(doubles([n, s, q]), int(n))
        mean, spread = float(s / n), float(max(q / n - (s / n) ** 2, 0.0))
        if not split:
            return ml.tree.LeafNode(mean, spread, said)
        feature, cut, gain = (x[i] for x in tree.notes[level][3:])
        where = ml.tree.ContinuousSplit(int(feature), float(fit.bins.cuts[feature][cut]))
        return ml.tree.InternalNode(mean, spread, float(gain), node(tree, sums, level + 1, 2 * i), node(tree, sums, level + 1, 2 * i + 1), where, said)

    width = len(fit.bins.cuts)
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(fit.trees))
    for i, (tree, sums) in enumerate(zip(fit.trees, leaves, strict=True)):
        trees[i] = ml.regression.DecisionTreeRegressionModel(f"{fit.estimator.uid}_{i}", node(tree, sums, 0, 0), width)
    model = GBTRegressionModel(ml.regression.GBTRegressionModel(fit.estimator.uid, trees, doubles(weights), width))
    model._resetUid(fit.estimator.uid)
    return fit.estimator._copyValues(model)
