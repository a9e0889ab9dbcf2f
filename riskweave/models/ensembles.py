"""Random forests of bounded depth as Spark ML estimators: trees grow in the tasks or, on many rows, together, a level per job.

Columns are cut into bins as for boosting, and rows lie in the same blocks of one byte per value. Blocks of up to SENT_BYTES
are sent to all tasks, and each grows whole trees. Beyond that every task
fills histograms of the rows' weights and weighted labels for a level, per tree, open node, drawn column and bin. They are merged by
tree in a shuffle, where the splits are decided, so the driver only sees splits. Trees are taken in groups whose histograms
hold HISTOGRAM_BYTES. Both ways give the same trees, but for rounding.

Bags are Poisson draws, seeded by tree and block, so every level and every repeated task sees the same ones. Splits
minimise the squared error, which for labels 0 and 1 is the Gini impurity.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Block, Growing, blocks_of, cuts_of, node_of
from .trees import TREE_SCHEMA, Tree

BINS = 32
HISTOGRAM_BYTES = 32_000_000
SENT_BYTES = 64_000_000  # of blocks that go to every task
WALKED = 400_000  # rows times trees that are walked together
CHANCE = 1 << 16
FLAT = 1e-12  # share of a node's weighted squares that a split must gain


def _poisson() -> np.ndarray:
    """Bag counts by 16 random bits: Poisson with mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(CHANCE) + 0.5) / CHANCE).astype(np.float64)


BAG = _poisson()


def bag(seed: int, tree: int, block: tuple[int, int], n: int) -> np.ndarray:
    return BAG.take(np.frombuffer(np.random.default_rng([seed, tree, *block]).bytes(2 * n), np.uint16))


@dataclass
class Branches:
    """A tree in the making. ``gain``: what a split takes from the squared error."""

    growing: Growing = field(default_factory=Growing)
    gain: list[float] = field(default_factory=lambda: [0.0])

    def tree(self, cuts: list[np.ndarray]) -> Tree:
        g = self.growing
        threshold = [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(g.feature, g.bin)]
        return Tree.of((g.feature, threshold, g.left, g.right, [s / w if w else 0.0 for w, s in g.sums], [w for w, _ in g.sums]))


def histograms(block: Block, number: tuple[int, int], seed: int, tree: int, arrays: tuple[np.ndarray, ...], nodes: list[int],
               columns: np.ndarray, bins: int) -> np.ndarray:
    """Weights and weighted labels of a block's bagged rows by open node, drawn column and bin."""
    w = bag(seed, tree, number, len(block.y)) * block.w
    rows = np.flatnonzero(w)
    x = block.x[rows]
    slot_of = np.full(len(arrays[0]), -1, np.int64)
    slot_of[nodes] = np.arange(len(nodes))
    slot = slot_of.take(node_of(arrays, x))
    inside = np.flatnonzero(slot >= 0)
    x, slot, rows = x[inside], slot[inside], rows[inside]
    w = w[rows]
    wy = w * block.y[rows]
    flat, first = x.reshape(-1), np.arange(len(x), dtype=np.int64) * x.shape[1]
    out = np.empty((len(nodes), columns.shape[1], bins, 2))
    for j in range(columns.shape[1]):
        place = slot * bins + flat.take(first + columns[:, j].take(slot))
        for i, part in enumerate((w, wy)):
            out[:, j, :, i] = np.bincount(place, part, len(nodes) * bins).reshape(-1, bins)
    return out


def splits_of(sums: np.ndarray) -> list[tuple]:
    """Per node (gain, drawn column, bin, sums left, sums right); ties go to the first column and bin."""
    left = sums.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    left, right = left[:, :, :-1, :], total - left[:, :, :-1, :]
    strength = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
    # A rest of rounding is no row.
    some = np.minimum(left[..., 0], right[..., 0]) > 1e-9 * total[..., 0]
    gain = np.where(some, strength(left) + strength(right) - strength(total), -np.inf)
    out = []
    for k, flat in enumerate(gain.reshape(len(gain), -1)):
        if not len(flat):
            out.append((-np.inf, 0, 0, tuple(total[k, 0, 0].tolist()), (0.0, 0.0)))
            continue
        j, b = divmod(int(flat.argmax()), gain.shape[2])
        out.append((float(flat.max()), j, b, tuple(left[k, j, b].tolist()), tuple(right[k, j, b].tolist())))
    return out


def drawn_columns(seed: int, tree: int, nodes: list[int], width: int, m: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, nodes[0], 1]).random((len(nodes), width)).argsort(axis=1)[:, :m]


def grown_here(tree: int, x: np.ndarray, numbers: Sequence[tuple], y: np.ndarray, weights: np.ndarray, bins: int, depth: int, m: int,
               seed: int, classes: bool) -> Branches:
    """A tree on the rows of all blocks. ``numbers``: (number, rows) of the blocks."""
    branches, width = Branches(), x.shape[1]
    g = branches.growing
    w = np.concatenate([bag(seed, tree, number, n) for number, n in numbers]) * weights
    rows = np.flatnonzero(w)
    x, w = x.take(rows, axis=0), w.take(rows)
    wy, slot = w * y.take(rows), np.zeros(len(rows), np.int64)
    while g.open and len(slot):
        nodes = g.open
        drawn, cells = drawn_columns(seed, tree, nodes, width, m), len(nodes) * bins
        flat, first, at = x.reshape(-1), np.arange(len(slot)) * width, slot * bins
        sums = np.empty((len(nodes), m, bins, 2))

        def fill(bin_of: np.ndarray) -> np.ndarray:
            place = at + bin_of
            return np.stack([np.bincount(place, v, cells).reshape(-1, bins) for v in (w, wy)], axis=-1)

        if m == width:
            for f in range(width):
                k, j = np.nonzero(drawn == f)
                sums[k, j] = fill(x[:, f])[k]
        else:
            for j in range(m):
                sums[:, j] = fill(flat.take(first + drawn[:, j].take(slot)))
        _decide(branches, nodes, drawn, sums[0, 0].sum(axis=0).tolist(), splits_of(sums), depth, classes)
        slot_of = np.full(len(g.feature), -1, np.int64)
        slot_of[g.open] = np.arange(len(g.open))
        feature, cut, left, right = g.arrays()
        held, column = np.array(nodes), np.maximum(feature[nodes], 0).astype(np.int64)
        goes_right = flat.take(first + column.take(slot)) > cut[held].take(slot)
        after = np.where(feature[held, None] >= 0, slot_of[np.stack([left[held], right[held]], axis=1)], -1).ravel()
        slot = after.take(2 * slot + goes_right)
        inside = np.flatnonzero(slot >= 0)
        if len(inside) < len(slot):
            x, slot, w, wy = x.take(inside, axis=0), slot.take(inside), w.take(inside), wy.take(inside)
    return branches


def packed(values: np.ndarray) -> tuple:
    """Values, and for up to 256 different ones their codes."""
    some, codes = np.unique(values, return_inverse=True)
    return (some, codes.astype(np.uint8)) if len(some) <= 256 else (values, None)


def _unpacked(values: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
    return values if codes is None else values.take(codes)


def planted(blocks, trees: int, cuts: list[np.ndarray], depth: int, m: int, seed: int, classes: bool) -> list[Branches] | None:
    """The trees, each grown by one task; None if the blocks are too large to be sent."""
    bins = max(map(len, cuts), default=0) + 1
    ready = blocks.mapPartitionsWithIndex(lambda part, held: (((part, i), b.x, packed(b.y), packed(b.w)) for i, b in enumerate(held)))
    # A packed block has a row's bins and one byte or eight for each of label and weight.
    if ready.map(lambda b: b[1].nbytes + sum(part.nbytes for pair in b[2:] for part in pair if part is not None)).sum() > SENT_BYTES:
        return None
    context = blocks.context
    shared = context.broadcast(ready.collect())

    def plant(numbers: Iterator[int]) -> Iterator[tuple]:
        x = np.concatenate([b[1] for b in shared.value])
        y, w = (np.concatenate([_unpacked(*b[k]) for b in shared.value]) for k in (2, 3))
        sizes = [(b[0], len(b[1])) for b in shared.value]
        for t in numbers:
            b = grown_here(t, x, sizes, y, w, bins, depth, m, seed, classes)
            g = b.growing
            yield t, (g.feature, g.bin, g.left, g.right, g.sums, g.level, b.gain)  # plain values: executors need no copy of this package

    found = dict(context.parallelize(range(trees), min(trees, 4 * context.defaultParallelism)).mapPartitions(plant).collect())
    shared.unpersist()
    return [Branches(Growing(*found[t][:-1], []), found[t][-1]) for t in range(trees)]


def grow(blocks, trees: int, cuts: list[np.ndarray], depth: int, m: int, seed: int, classes: bool) -> list[Branches]:
    if (forest := planted(blocks, trees, cuts, depth, m, seed, classes)) is not None:
        return forest
    width, bins = len(cuts), max(map(len, cuts), default=0) + 1
    forest = [Branches() for _ in range(trees)]
    room = max(1, HISTOGRAM_BYTES // (m * bins * 16))
    tasks = blocks.getNumPartitions()
    for _ in range(depth):
        waiting = {t: list(b.growing.open) for t, b in enumerate(forest) if b.growing.open}
        while waiting:
            asked, left = {}, room
            for t, nodes in list(waiting.items()):
                if asked and len(nodes) > left:
                    break
                asked[t] = (forest[t].growing.arrays(), nodes, drawn_columns(seed, t, nodes, width, m))
                left -= len(nodes)
                del waiting[t]

            def fill(part: int, held: Iterator[Block], asked=asked):
                sums: dict[int, np.ndarray] = {}
                for i, block in enumerate(held):
                    for t, (arrays, nodes, drawn) in asked.items():
                        own = histograms(block, (part, i), seed, t, arrays, nodes, drawn, bins)
                        sums[t] = sums[t] + own if t in sums else own
                return iter(sums.items())

            merged = blocks.mapPartitionsWithIndex(fill).reduceByKey(np.add, min(tasks, len(asked)))
            found = dict(merged.mapValues(lambda s: (s[0, 0].sum(axis=0).tolist(), splits_of(s))).collect())
            for t, (_, nodes, drawn) in asked.items():
                _decide(forest[t], nodes, drawn, *found[t], depth, classes)
    return forest


def _decide(branches: Branches, nodes: list[int], drawn: np.ndarray, total: list[float], splits: list[tuple], depth: int, classes: bool) -> None:
    g = branches.growing
    if nodes == [0]:
        g.sums[0] = tuple(total)
    g.open = []
    for node, columns, (gain, j, b, left, right) in zip(nodes, drawn, splits):
        w, s = g.sums[node]
        pure = classes and min(s, w - s) <= 1e-9 * w
        if pure or gain <= FLAT * max(abs(s), s * s / w if w else 0.0):
            continue
        g.split(node, int(columns[j]), b, left, right, depth)
        branches.gain[node] = gain
        branches.gain += [0.0, 0.0]


def stacked(trees: Sequence[Tree]) -> tuple[np.ndarray, ...]:
    """Trees side by side in plain arrays, for walking rows down all of them at once; leaves lead back to themselves."""
    starts = np.cumsum([0, *[len(t.feature) for t in trees]])
    leaf, own = np.concatenate([t.feature < 0 for t in trees]), np.arange(starts[-1])
    left, right = (np.where(leaf, own, np.concatenate([getattr(t, side) + s for t, s in zip(trees, starts)])) for side in ("left", "right"))
    feature, threshold, value = (np.concatenate([getattr(t, part) for t in trees]) for part in ("feature", "threshold", "value"))
    return np.stack([left, right], axis=1).ravel(), np.where(leaf, 0, feature).astype(np.int64), threshold, value, leaf, starts[:-1]


def walked(trees: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The sum of the leaves that every row reaches."""
    after, feature, threshold, value, leaf, roots = trees
    out, step = np.empty(len(x)), max(1, WALKED // len(roots))
    for lo in range(0, len(x), step):
        rows = np.ascontiguousarray(x[lo : lo + step])
        flat, first = rows.reshape(-1), (np.arange(len(rows)) * rows.shape[1])[:, None]
        at = np.repeat(roots[None, :], len(rows), axis=0)
        while not leaf.take(at).all():
            at = after.take(2 * at + ~(flat.take(first + feature.take(at)) <= threshold.take(at)))
        out[lo : lo + step] = value.take(at).sum(axis=1)
    return out


def mean_of(trees: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    return walked(trees, x) / len(trees[-1])


class RandomForest(Estimator):
    """``classes``: labels are 0 and 1, and the model gives probabilities; otherwise it gives the label's mean. ``columns``: how
    many are tried at each node, the root of their number (rounded up) if None."""

    def __init__(self, features: str, label: str, trees: int, depth: int, seed: int, classes: bool, weight: str | None = None,
                 columns: int | None = None, bins: int = BINS):
        super().__init__()
        self.features, self.label, self.trees, self.depth, self.seed = features, label, trees, depth, seed
        self.classes, self.weight, self.columns, self.bins = classes, weight, columns, bins

    def _fit(self, dataset: DataFrame) -> "RandomForestModel":
        first = dataset.select(self.features).first()
        if first is None:
            raise ValueError("there are no rows to fit a forest on")
        width = first[0].size
        names = [f"x{i}" for i in range(width)]
        rows = dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("label"),
                              (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("weight"))
        if self.classes and not rows.where("label IS NULL OR label NOT IN (0, 1)").isEmpty():
            raise ValueError("labels must be 0 or 1")
        rows = rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)], "label", "weight").persist()
        try:
            cuts = cuts_of(rows, names, "weight", self.bins)
            blocks = blocks_of(rows, names, "label", "weight", [F.lit(True)], cuts, 0.0)
        finally:
            rows.unpersist()
        m = min(width, self.columns or math.ceil(math.sqrt(width)))
        forest = grow(blocks, self.trees, cuts, self.depth, m, self.seed, self.classes)
        blocks.unpersist()
        total = np.zeros(width)
        for b in forest:
            feature, gain = np.array(b.growing.feature), np.array(b.gain)
            own = np.bincount(feature[feature >= 0], gain[feature >= 0], width)
            total += own / (own.sum() or 1.0)
        return RandomForestModel(self.features, self.classes, [b.tree(cuts) for b in forest], (total / (total.sum() or 1.0)).tolist())


class RandomForestModel(Model, MLWritable, MLReadable):
    """Fitted trees; their size is set by number and depth, whatever the data's."""

    def __init__(self, features: str, classes: bool, trees: Sequence[Tree], importances: Sequence[float]):
        super().__init__()
        self.features, self.classes, self.trees, self.importances = features, classes, list(trees), list(importances)

    @property
    def featureImportances(self):
        """Per column the squared error that its splits take away, each tree's adding up to 1, then averaged."""
        return Vectors.dense(self.importances)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(stacked(self.trees))

        @F.pandas_udf("double")
        def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(mean_of(shared.value, np.vstack(batch.to_numpy())) if len(batch) else np.empty(0))

        out = mean(vector_to_array(self.features))
        if not self.classes:
            return dataset.withColumn("prediction", out)
        p, n = F.col("_p"), float(len(self.trees))
        return dataset.withColumn("_p", out).withColumns({
            "rawPrediction": array_to_vector(F.array((1 - p) * n, p * n)), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (p > 0.5).cast("double")}).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RandomForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "features": m.features, "classes": m.classes, "importances": m.importances})
        rows = self.sparkSession.createDataFrame([(i, *t.parts()) for i, t in enumerate(m.trees)], TREE_SCHEMA)
        rows.coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> RandomForestModel:
        m = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()  # one row per tree
        return RandomForestModel(m["features"], m["classes"], [Tree.of(tuple(r)[1:]) for r in rows], m["importances"])


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
