"""First-order gradient boosting as Spark's GBTClassifier and GBTRegressor fit it, with a short job for two tree levels.

For classes the first tree fits labels of -1 and 1, every later one the gradient of the logistic loss; for numbers it fits
the label's distance from the mean, and later ones the gradient of the squared error. Splits take most from the variance
and leaves are means. Columns are cut into bins, and rows equal in all bins and the label become one with the sum of their
weights. These lie in blocks of one byte per value, as for second-order boosting, with the scores of finished trees.

Every task adds up weights and weighted gradients of its rows, and the driver decides the splits from the sums. What a job
costs at least is the same for few and many rows, so one job serves two levels where its sums stay small (JOINT_BYTES): they are
taken per open node, pair of columns and pair of bins, which tells the sums of the node and, whatever its split, of both
children. Else they are taken per open node, column and bin, and of two siblings only for the lighter one; the other's are
what the parent's leave.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .boosting import BLOCK_ROWS, COLLECT_BYTES, FLUSH, KEEP, cuts_of, node_of
from .ensembles import FLAT, Branches, splits_of, stacked, walked
from .trees import TREE_SCHEMA, Tree

BINS = 32
TASK_ROWS = 30_000  # a task takes at least so many rows
JOINT_BYTES = 16_000_000  # sums over pairs of columns that all tasks send to the driver
COUNTED = 10_000  # up to so many rows (Spark's sample for cuts) cuts come from counts of single values
TOLERANCE = 0.001  # share of the loss by which a round must improve on the best one
NOISE = 1e-9  # share of a node's weight below which a rest is rounding and no row


@dataclass(frozen=True)
class Settings:
    rounds: int
    depth: int
    rate: float
    classes: bool = True


@dataclass
class Block:
    """``x``: bins by row and column; ``y``: -1 or 1, or a distance from the mean; ``score``: of stored trees."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    learns: np.ndarray
    score: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame, width: int, kind: type) -> "Block":
        x = np.frombuffer(b"".join(rows["x"]), kind).reshape(-1, width)
        y, w, learns = (rows[c].to_numpy() for c in ("y", "w", "learns"))
        return Block(x, y, w, learns.astype(bool), np.zeros(len(y)))


@dataclass(frozen=True)
class Ask:
    """What a job has to know: trees that are not in the stored scores, the growing one, and the nodes to sum up."""

    begun: bool  # a tree is finished
    pending: list[tuple]
    growing: tuple[np.ndarray, ...]
    nodes: list[int]
    joint: bool  # per pair of columns
    validate: bool  # tell the loss on the rows not learnt from
    classes: bool = True


def loss_of(y: np.ndarray, score: np.ndarray, classes: bool) -> np.ndarray:
    return 2 * np.logaddexp(0, -2 * y * score) if classes else (y - score) ** 2


def downhill(y: np.ndarray, score: np.ndarray, classes: bool) -> np.ndarray:
    """The loss's negative gradient in the score."""
    return 4 * y / (1 + np.exp(np.minimum(2 * y * score, 700))) if classes else 2 * (y - score)


def current(block: Block, pending: list[tuple]) -> np.ndarray:
    score = block.score
    for arrays, value in pending:
        score = score + value.take(node_of(arrays, block.x))
    return score


def summed(block: Block, ask: Ask, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted gradients of the rows learnt from, by node and place, and (loss, weight) of the others. Places are
    the bins of every column side by side or, if joint, the cells of every pair of columns."""
    score, y = current(block, ask.pending), block.y
    told = np.zeros(2)
    if ask.validate:
        rest = ~block.learns
        w = block.w[rest]
        told = np.array([(w * loss_of(y[rest], score[rest], ask.classes)).sum(), w.sum()])
    slot_of = np.full(len(ask.growing[0]), -1, np.int64)
    slot_of[ask.nodes] = np.arange(len(ask.nodes))
    slot = slot_of.take(node_of(ask.growing, block.x))
    rows = np.flatnonzero((slot >= 0) & block.learns)
    slot, w, y, score = (v.take(rows) for v in (slot, block.w, y, score))
    wt = w * (downhill(y, score, ask.classes) if ask.begun else y)
    columns = np.ascontiguousarray(block.x.take(rows, axis=0).T)
    parts = [np.zeros((len(ask.nodes), 0, 2))]
    for chosen in combinations(range(len(sizes)), 2 if ask.joint else 1):
        cells, place = 1, 0
        for f in chosen:
            cells, place = cells * sizes[f], place * sizes[f] + columns[f].astype(np.int64)
        place += slot * cells
        parts.append(np.stack([np.bincount(place, v, len(ask.nodes) * cells).reshape(-1, cells) for v in (w, wt)], axis=-1))
    return np.concatenate(parts, axis=1), told


def _plus(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _sums(blocks: RDD, ask: Ask, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``summed`` over all blocks, in one job."""

    def add(parts: Iterator[Block]) -> Iterator[tuple]:
        sums = None
        for block in parts:
            own = summed(block, ask, sizes)
            sums = own if sums is None else _plus(sums, own)
        if sums is not None:
            yield sums

    merged = blocks.mapPartitions(add)
    if not ask.joint and blocks.getNumPartitions() * len(ask.nodes) * sum(sizes) * 16 > COLLECT_BYTES:
        return merged.treeReduce(_plus, 2)
    first, *others = merged.collect()
    for other in others:
        first = _plus(first, other)
    return first


def side_by_side(columns: Sequence[np.ndarray], bins: int) -> np.ndarray:
    """Sums by column and bin, all columns with as many bins."""
    return np.stack([np.pad(c, ((0, bins - len(c)), (0, 0))) for c in columns])


class Pairs:
    """A node's sums over pairs of columns."""

    def __init__(self, cells: np.ndarray, sizes: list[int]):
        self.sizes, self.held, at = sizes, {}, 0
        for f, h in combinations(range(len(sizes)), 2):
            self.held[f, h] = cells[at : at + sizes[f] * sizes[h]].reshape(sizes[f], sizes[h], 2)
            self.held[h, f] = self.held[f, h].transpose(1, 0, 2)
            at += sizes[f] * sizes[h]

    def column(self, f: int) -> np.ndarray:
        return self.held[f, 0 if f else 1].sum(axis=1)

    def node(self) -> np.ndarray:
        return side_by_side([self.column(f) for f in range(len(self.sizes))], max(self.sizes))

    def child(self, f: int, inside: np.ndarray) -> np.ndarray:
        """The sums of the rows in some of a column's bins."""
        own = self.column(f) * inside[:, None]
        return side_by_side([own if h == f else self.held[f, h][inside].sum(axis=0) for h in range(len(self.sizes))], max(self.sizes))


def boost(blocks: RDD, sizes: list[int], settings: Settings, validate: bool) -> list[Branches]:
    """The trees. With validation rows the boosting ends once a round gains too little there, and the rounds up to the best
    are kept."""
    forest: list[Branches] = []
    pending: list[tuple] = []
    best, kept, stored, old = np.inf, settings.rounds, 0, None
    bounds = np.cumsum(sizes)[:-1]
    pair_bytes = 16 * sum(a * b for a, b in combinations(sizes, 2)) * blocks.getNumPartitions()
    while len(forest) < settings.rounds:
        branches = Branches()
        g, pairs, told = branches.growing, [(0,)], {}  # told: sums of nodes that no job has to ask for
        above: dict[tuple[int, ...], np.ndarray] = {}
        for depth in range(settings.depth):
            level, joint = told, {}
            if not told:
                nodes = sorted(node for pair in pairs for node in pair)
                both = len(sizes) > 1 and depth + 1 < settings.depth and len(nodes) * pair_bytes <= JOINT_BYTES
                light = nodes if both else [min(pair, key=lambda node: (g.sums[node][0], node)) for pair in pairs]
                # The first job after a tree also tells what that tree did to the loss.
                ask = Ask(bool(forest), pending, g.arrays(), light, both, validate and depth == 0, settings.classes)
                found, (loss, weight) = _sums(blocks, ask, sizes)
                if old is not None:
                    old.unpersist()
                    old = None
                if ask.validate and forest:
                    now = loss / weight if weight else np.nan
                    if len(forest) == 1:
                        best, kept = now, 1
                    elif best - now < TOLERANCE * max(now, 0.01):
                        return _ended(blocks, forest[:kept])
                    elif now < best:
                        best, kept = now, len(forest)
                if both:
                    joint = {node: Pairs(cells, sizes) for node, cells in zip(light, found)}
                    level = {node: p.node() for node, p in joint.items()}
                else:
                    level = {node: side_by_side(np.split(own, bounds), max(sizes)) for node, own in zip(light, found)}
                    for node, pair in zip(light, pairs):
                        for other in set(pair) - {node}:
                            rest = above[pair] - level[node]
                            rest[rest[..., 0] <= NOISE * g.sums[other][0]] = 0.0
                            level[other] = rest
            if depth == 0:
                g.sums[0] = tuple(level[0][0].sum(axis=0).tolist())
            nodes, pairs, above, told = sorted(level), [], {}, {}
            for node, (gain, f, b, left, right) in zip(nodes, splits_of(np.stack([level[n] for n in nodes]))):
                w, s = g.sums[node]
                if not gain > FLAT * s * s / w:
                    continue
                g.split(node, f, b, left, right, settings.depth)
                branches.gain[node] = gain
                branches.gain += [0.0, 0.0]
                pairs.append((g.left[node], g.right[node]))
                above[pairs[-1]] = level[node]
                if node in joint:
                    below = np.arange(sizes[f]) <= b
                    told[g.left[node]], told[g.right[node]] = joint[node].child(f, below), joint[node].child(f, ~below)
            if not pairs:
                break
        rate = settings.rate if forest else 1.0
        pending = [*pending, (g.arrays(), np.array([rate * s / w if w else 0.0 for w, s in g.sums]))]
        forest.append(branches)
        if len(pending) >= FLUSH:
            old, blocks = blocks, blocks.map(lambda b, done=pending: replace(b, score=current(b, done))).persist(StorageLevel.MEMORY_AND_DISK)
            pending, stored = [], stored + 1
            if stored % KEEP == 0:
                blocks.checkpoint()
    if validate:
        _, (loss, weight) = _sums(blocks, Ask(True, pending, Branches().growing.arrays(), [], False, True, settings.classes), sizes)
        now = loss / weight if weight else np.nan
        if len(forest) == 1 or (best - now >= TOLERANCE * max(now, 0.01) and now < best):
            kept = len(forest)
    if old is not None:
        old.unpersist()
    return _ended(blocks, forest[:kept])


def _ended(blocks: RDD, forest: list[Branches]) -> list[Branches]:
    blocks.unpersist()
    return forest


def counted_cuts(rows: DataFrame, width: int, most: int) -> list[np.ndarray]:
    """Cuts halfway between neighbouring values: between all, or the nearest to equal weight between ``most`` cuts."""
    one = rows.select("w", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("w").alias("w")).toPandas().sort_values(["f", "v"])
    out = []
    for f in range(width):
        own = one[one["f"] == f]
        v, upto = own["v"].to_numpy(), own["w"].to_numpy().cumsum()
        between = (v[:-1] + v[1:]) / 2
        if len(between) > most:
            stride, wanted, at = upto[-1] / (most + 1), upto[-1] / (most + 1), []
            for i in range(1, len(v)):
                if abs(upto[i - 1] - wanted) < abs(upto[i] - wanted):
                    at.append(i - 1)
                    wanted += stride
            between = between[at]
        out.append(between)
    return out


def blocks_of(rows: DataFrame, width: int, cuts: list[np.ndarray], kind: type, tasks: int) -> RDD:
    """Of rows (x, y, w, learns)."""

    @F.pandas_udf("binary")
    def binned(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.vstack(batch.to_numpy())
        return pd.Series([b.tobytes() for b in np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(kind)])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield pd.DataFrame({"block": [cloudpickle.dumps(Block.of(pd.concat(held), width, kind))]})
                held = []
        if sum(map(len, held)):
            yield pd.DataFrame({"block": [cloudpickle.dumps(Block.of(pd.concat(held), width, kind))]})

    alike = rows.select(binned("x").alias("x"), "y", "w", "learns").where("w > 0").groupBy(
        "x", "y", "learns").agg(F.sum("w").alias("w"))
    # The order of rows only matters for rounding, but it must be the same in every run.
    dealt = alike.repartition(tasks, F.xxhash64("x", "y", "learns")).sortWithinPartitions("x", "y", "learns")
    packed = materialize(dealt.mapInPandas(pack, "block binary"))
    return packed.rdd.map(lambda r: cloudpickle.loads(bytes(r["block"]))).persist(StorageLevel.MEMORY_AND_DISK)


class GradientTrees(Estimator):
    """``classes``: labels are 0 and 1, otherwise numbers. ``validation`` names a boolean column; rows marked true are not
    learnt from and stop the boosting early."""

    def __init__(self, features: str, label: str, rounds: int, depth: int, rate: float, weight: str | None = None,
                 validation: str | None = None, bins: int = BINS, classes: bool = True):
        super().__init__()
        self.features, self.label, self.settings = features, label, Settings(rounds, depth, rate, classes)
        self.weight, self.validation, self.bins = weight, validation, bins

    def _fit(self, dataset: DataFrame) -> "GradientTreesModel":
        first = dataset.select(self.features).first()
        if first is None:
            raise ValueError("there are no rows to fit trees on")
        width, validate = first[0].size, self.validation is not None
        rows = dataset.select(
            vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("label"),
            (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("w"),
            (~F.col(self.validation) if validate else F.lit(True)).alias("learns")).where("learns IS NOT NULL").persist()
        try:
            allowed = "label IN (0, 1)" if self.settings.classes else "abs(label) < double('Infinity')"
            n, told, fine, known, mean = rows.agg(
                F.count("*"), F.count_if("learns"), F.expr(f"count_if({allowed})"), F.expr("count_if(w >= 0)"),
                F.avg(F.when(F.col("learns") & (F.col("w") > 0), F.col("label")))).first()
            if fine < n or known < n:
                raise ValueError("weights must not be negative" if fine == n else "labels must be 0 or 1" if self.settings.classes else
                                 "labels must be finite numbers")
            if not told:
                raise ValueError("there are no rows to fit trees on")
            # Splits are the same wherever the labels' zero lies, but sums of squares far from it lose digits.
            shift = 0.0 if self.settings.classes else mean or 0.0
            rows = rows.withColumn("y", 2 * F.col("label") - 1 if self.settings.classes else F.col("label") - F.lit(shift))
            return self._fitted(rows, n, told, width, validate, shift)
        finally:
            rows.unpersist()

    def _fitted(self, rows: DataFrame, n: int, told: int, width: int, validate: bool, shift: float) -> "GradientTreesModel":
        learnt = rows.where("learns")
        if told <= COUNTED:
            cuts = counted_cuts(learnt, width, min(self.bins, told) - 1)
        else:
            names = [f"x{i}" for i in range(width)]
            cuts = cuts_of(learnt.select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)], "w"), names, "w", self.bins)
        sizes, settings = [len(c) + 1 for c in cuts], self.settings
        tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
        forest = boost(blocks_of(rows, width, cuts, np.uint8 if self.bins <= 256 else np.uint16, tasks), sizes, settings, validate)
        trees, importances = [], np.zeros(width)
        for k, branches in enumerate(forest):
            tree, gain = branches.tree(cuts), np.array(branches.gain)
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], gain[inner], width)
            importances += own / (own.sum() or 1.0)
            trees.append(replace(tree, value=tree.value * settings.rate if k else tree.value + shift))
        return GradientTreesModel(self.features, trees, (importances / (importances.sum() or 1.0)).tolist(), settings.classes)


class GradientTreesModel(Model, MLWritable, MLReadable):
    """Fitted trees, their leaves times the rate; their size is set by number and depth, whatever the data's."""

    def __init__(self, features: str, trees: Sequence[Tree], importances: Sequence[float], classes: bool = True):
        super().__init__()
        self.features, self.trees, self.importances, self.classes = features, list(trees), list(importances), classes

    @property
    def featureImportances(self):
        """Per column the variance that its splits take away, each tree's adding up to 1, then averaged."""
        return Vectors.dense(self.importances)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(stacked(self.trees))

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(walked(shared.value, np.vstack(batch.to_numpy())) if len(batch) else np.empty(0))

        out = margin(vector_to_array(self.features))
        if not self.classes:
            return dataset.withColumn("prediction", out)
        m = F.col("_m")
        p = 1 / (1 + F.exp(-2 * m))
        return dataset.withColumn("_m", out).withColumns({
            "rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (m > 0).cast("double")}).drop("_m")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: GradientTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "features": m.features, "classes": m.classes, "importances": m.importances})
        rows = self.sparkSession.createDataFrame([(i, *t.parts()) for i, t in enumerate(m.trees)], TREE_SCHEMA)
        rows.coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> GradientTreesModel:
        m = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()  # one row per tree
        return GradientTreesModel(m["features"], [Tree.of(tuple(r)[1:]) for r in rows], m["importances"], m.get("classes", True))


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
