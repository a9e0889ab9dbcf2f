"""Coefficients, importances and additive attributions of fitted models."""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_k, top_k_by_abs
from ..operators.profile import STATS, with_stats
from ..session import materialize, shared_dir
from .boosting import Boosted
from .ensembles import RandomForestModel, stacked
from .trees import Tree, numbers


def named_values(spark, names: Sequence[str], values: Sequence[float], column: str) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], f"feature string, {column} double")


def coefficients(spark, model, names: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` largest linear coefficients by size."""
    return top_k_by_abs(named_values(spark, names, model.coefficients.toArray(), "coefficient"), "coefficient", "feature", k)


def feature_importance(spark, model, names: Sequence[str], k: int = 10) -> DataFrame:
    table = named_values(spark, names, model.featureImportances.toArray(), "importance")
    return top_k(table, k, F.desc("importance"), F.asc("feature"))


def linear_attribution(df: DataFrame, weights: dict[str, float], fit_on: DataFrame | None = None) -> DataFrame:
    """Exact additive attribution of a linear score: weight * (value - mean), one column per feature.
    A row's attributions add up to its score minus the mean score."""
    means = (fit_on if fit_on is not None else df).agg(*[F.avg(c).alias(c) for c in weights])
    return with_stats(df, means).withColumns({
        f"phi_{c}": F.lit(float(w)) * (F.col(c) - F.col(STATS)[c]) for c, w in weights.items()}).drop(STATS)


# ---------------------------------------------------------------- trees

ROWS = 4096  # walked together
NODES_SENT = 2_000_000  # nodes of the trees that go to the tasks as one broadcast
TABLE_BYTES = 256_000_000  # tables of all coalitions that a task may hold
PIECE_ROWS = 1_000_000  # of one bin of the sliced feature that a task answers
LEAVES = 4096  # entered into a table together
TINY = 1e-15  # share of a branch that no training row took


def forest_rows(model, spark) -> DataFrame:
    """Node rows of a forest classifier fitted by Spark, in its own model format."""
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    return spark.read.parquet(f"{path}/data")


def nodes_of(rows) -> list[list[dict]]:
    """Node tables by tree; their size is set by the model's, whatever the data's."""
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = r["nodeData"]
        stats = list(node["impurityStats"])
        split = node["split"]
        left, right, cut = node["leftChild"], node["rightChild"], 0.0
        if left >= 0:
            cut = split["leftCategoriesOrThreshold"][0]
            if split["numCategories"] == 2:  # a 0/1 column: the listed category goes left
                left, right, cut = (left, right, 0.5) if cut == 0.0 else (right, left, 0.5)
            elif split["numCategories"] != -1:
                raise ValueError("splits on more than two categories are not supported; use one-hot columns")
        trees.setdefault(r["treeID"], {})[node["id"]] = {
            "left": left, "right": right, "feature": split["featureIndex"], "threshold": cut,
            "cover": sum(stats), "value": stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0,
        }
    return [[t[i] for i in sorted(t)] for _, t in sorted(trees.items())]


def nodes_of_tree(tree: Tree) -> list[dict]:
    return [dict(zip(("feature", "threshold", "left", "right", "value", "cover"), node)) for node in zip(*tree.parts())]


def forest_nodes(model, spark) -> list[list[dict]]:
    """Node tables of our own forests, or of Spark's."""
    if isinstance(model, RandomForestModel):
        return [nodes_of_tree(t) for t in model.trees]
    return nodes_of(forest_rows(model, spark).collect())


def tree_of(nodes: list[dict]) -> Tree:
    return Tree.of(([n["feature"] if n["left"] >= 0 else -1 for n in nodes],
                    *([n[part] for n in nodes] for part in ("threshold", "left", "right", "value", "cover"))))


def shares_of(tree: Tree) -> np.ndarray:
    """Per node the share of its parent's training rows that took the branch to it; 1 for the root."""
    share = np.ones(len(tree.feature))
    inner = np.flatnonzero(tree.feature >= 0)
    for side in (tree.left, tree.right):
        cover = tree.cover[inner]
        share[side[inner]] = np.divide(tree.cover[side[inner]], cover, out=np.zeros(len(inner)), where=cover > 0)
    return share


def most_features(tree: Tree) -> int:
    """The largest number of different features on a path."""
    most, todo = 0, [(0, frozenset())]
    while todo:
        node, seen = todo.pop()
        if tree.feature[node] < 0:
            most = max(most, len(seen))
        else:
            seen = seen | {int(tree.feature[node])}
            todo += [(int(tree.left[node]), seen), (int(tree.right[node]), seen)]
    return most


def tree_attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values (Lundberg et al., 2020) for a batch of rows, in one walk over the tree.

    A leaf is a game among the features on its path: in the coalition a feature lets the row pass only if the row takes
    the path's turns, outside it passes the share of training rows that do. If every feature joins with chance t, the
    game's value is the product of (1 - t) share + t pass, and a feature's Shapley value is the integral over t of what
    it adds. The product has a degree below the number of features, so Gauss-Legendre points give the integral exactly.
    Products are carried down at these points, sums of leaves carried up; at the branch where a feature last appears its
    factor is exchanged for what it adds, so every branch costs a few operations per row and point, however deep it lies.
    """
    phi = np.zeros(x.shape)
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-most_features(tree) // 2)))
    t, weights = (points[:, None] + 1) / 2, weights / 2
    shares = shares_of(tree)
    for i in range(0, len(x), ROWS):
        rows = x[i : i + ROWS]
        out = phi[i : i + ROWS]
        held: dict[int, tuple] = {}  # per feature on the way: share, pass, factor
        # A branch is met twice: on the way down (node >= 0), and on the way up with what its factor replaced.
        todo: list[tuple] = [(0, np.ones((len(t), len(rows))), None)]
        sums: list[np.ndarray] = []  # of the finished subtrees
        while todo:
            node, product, branch = todo.pop()
            if node < 0:
                f, before = branch
                s = sums[-1]
                share, passes, factor = held[f]
                out[:, f] += weights @ (s / factor) * (passes - share)
                if before is None:
                    del held[f]
                else:
                    out[:, f] -= weights @ (s / before[2]) * (before[1] - before[0])
                    held[f] = before
                if product is not None:  # the second child: both are finished
                    sums[-2:] = [sums[-2] + sums[-1]]
                continue
            if branch is not None:
                f, goes, last = branch
                before = held.get(f)
                share, passes = (before[0], before[1]) if before else (1.0, np.ones(len(rows), bool))
                share, passes = max(share * shares[node], TINY), passes & goes
                factor = (1 - t) * share + t * passes
                product = product * factor if before is None else product / before[2] * factor
                held[f] = share, passes, factor
                todo.append((-1, True if last else None, (f, before)))
            f = int(tree.feature[node])
            if f < 0:
                sums.append(tree.value[node] * product)
                continue
            below = rows[:, f] <= tree.threshold[node]
            todo += [(int(tree.right[node]), product, (f, ~below, True)), (int(tree.left[node]), product, (f, below, False))]
    return phi


def base_value(tree: Tree) -> float:
    """Mean output over the training rows, as the tree recorded it."""
    shares, reach = shares_of(tree), np.zeros(len(tree.feature))
    reach[0], todo = 1.0, [0]
    while todo:
        node = todo.pop()
        if tree.feature[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                reach[child] = reach[node] * shares[child]
                todo.append(child)
    return float((reach * tree.value)[tree.feature < 0].sum())


def forest_base_value(trees: list[list[dict]]) -> float:
    return float(np.mean([base_value(tree_of(t)) for t in trees]))


def attributions(spark, x: Column, width: int, trees: Sequence[Tree]) -> Column:
    """Array of the trees' summed attributions for features in the array ``x``. Trees are sent in groups of at most
    NODES_SENT nodes, or single ones; their size is set by the model."""
    groups, held = [[]], 0
    for tree in trees:
        if groups[-1] and held + len(tree.feature) > NODES_SENT:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += len(tree.feature)
    # Plain arrays: executors need no copy of this package to read them.
    parts = [_summed(spark.sparkContext.broadcast([tuple(vars(t).values()) for t in group]), width)(x) for group in groups]
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total


def _summed(shared, width: int):
    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            phi = np.zeros((len(batch), width))
            if len(batch):
                rows = np.vstack(batch.to_numpy())
                for parts in shared.value:
                    phi += tree_attributions(Tree(*parts), rows)
            yield pd.Series(list(phi), dtype=object)

    return attribute


# ---------------------------------------------------------------- attributions from tables

@dataclass(frozen=True)
class Boxes:
    """The leaves of a forest over bins. ``cuts``: by feature, all thresholds of the trees. ``low``, ``high``: by leaf and
    feature, the bins that pass. ``share``: by leaf and feature, the training rows that pass where the feature is unknown."""

    cuts: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], axis=1)

    def sliced(self) -> tuple[int, list[int]]:
        """The feature with most bins, and the others that some tree splits on."""
        first = int(np.argmax(self.sizes))
        return first, [f for f, c in enumerate(self.cuts) if len(c) and f != first]

    def table_bytes(self) -> int:
        """Of the tables with and without the sliced feature."""
        return 16 * math.prod(self.sizes[f] + 1 for f in self.sliced()[1])


def boxes_of(trees: Sequence[Tree], width: int) -> Boxes:
    after, feature, threshold, value, leaf, roots = stacked(trees)
    share = np.concatenate([shares_of(t) for t in trees])
    cuts = [np.unique(threshold[~leaf & (feature == f)]) for f in range(width)]
    nodes = roots
    low, high = np.zeros((len(roots), width), np.int32), np.tile(np.array([len(c) for c in cuts], np.int32), (len(roots), 1))
    known = np.ones((len(roots), width))
    done: list[tuple] = []
    while len(nodes):
        ends = leaf[nodes]
        done.append((low[ends], high[ends], known[ends], value[nodes[ends]]))
        nodes, low, high, known = nodes[~ends], low[~ends], high[~ends], known[~ends]
        f, rows = feature[nodes], np.arange(len(nodes))
        cut = np.zeros(len(nodes), np.int32)
        for i, c in enumerate(cuts):
            cut[f == i] = np.searchsorted(c, threshold[nodes[f == i]])
        sides = []
        for side in (0, 1):
            child, lo, hi, part = after[2 * nodes + side], low.copy(), high.copy(), known.copy()
            if side:
                lo[rows, f] = np.maximum(lo[rows, f], cut + 1)
            else:
                hi[rows, f] = np.minimum(hi[rows, f], cut)
            part[rows, f] *= share[child]
            sides.append((child, lo, hi, part))
        nodes, low, high, known = (np.concatenate(pair) for pair in zip(*sides))
    low, high, known, value = (np.concatenate(p) for p in zip(*done))
    return Boxes(cuts, np.minimum(low, high + 1), high, known, value)


def table_of(boxes: Boxes, features: Sequence[int], leaves: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sums of leaf weights for all coalitions among ``features`` and all their bins. An axis has a feature's bins and, as
    its last place, the feature unknown; a leaf fills a box of the bins, and its share of it at the last place."""
    shape = [boxes.sizes[f] + 1 for f in features]
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    table = np.zeros(math.prod(shape))
    for i in range(0, len(leaves), LEAVES):
        own, at, w = leaves[i : i + LEAVES], np.zeros(len(leaves[i : i + LEAVES]), np.int64), weight[i : i + LEAVES]
        for f, stride in zip(features, strides):  # where a box begins and, negative, ends: running totals fill it
            end = boxes.high[own, f] + 1
            inner, some = np.flatnonzero(end < boxes.sizes[f]), boxes.share[own, f]
            known = np.flatnonzero(some)
            at, w, own = (np.concatenate(p) for p in zip(
                (at + boxes.low[own, f] * stride, w, own), (at[inner] + end[inner] * stride, -w[inner], own[inner]),
                (at[known] + boxes.sizes[f] * stride, w[known] * some[known], own[known])))
        np.add.at(table, at, w)
    for axis, size in enumerate(shape):
        view = table.reshape(math.prod(shape[:axis]), size, -1)
        for b in range(1, size - 1):
            view[:, b] += view[:, b - 1]
    return table


def chances(n: int) -> np.ndarray:
    """By feature and coalition of ``n`` features (a bit each, the first one's highest) what a coalition's value counts."""
    out = np.zeros((n, 2**n))
    for c, members in enumerate(product((False, True), repeat=n)):
        for f in range(n):
            k = sum(members) - members[f]
            out[f, c] = (1 if members[f] else -1) * math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
    return out


def table_attributions(boxes: Boxes, bins: np.ndarray, tables: dict | None = None) -> np.ndarray:
    """The trees' summed path-dependent Shapley values for rows in one bin of the sliced feature, given as bins. The value
    of a coalition is the sum over the leaves of the shares of features outside it, where the row passes inside, and is read
    from tables of all coalitions and bins: a row costs as many look-ups as there are coalitions, whatever the trees.
    ``tables`` keeps what other slices need, too."""
    first, others = boxes.sliced()
    tables = {} if tables is None else tables
    if "without" not in tables:
        tables["without"] = table_of(boxes, others, np.arange(len(boxes.value)), boxes.value * boxes.share[:, first])
    here = int(bins[0, first])
    if tables.get("here") != here:
        passing = np.flatnonzero((boxes.low[:, first] <= here) & (here <= boxes.high[:, first]))
        tables["with"], tables["here"] = table_of(boxes, others, passing, boxes.value[passing]), here
    shape = [boxes.sizes[f] + 1 for f in others]
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    counts = chances(len(others) + 1)
    phi = np.zeros((len(bins), len(boxes.cuts)))
    for i in range(0, len(bins), ROWS):
        rows = bins[i : i + ROWS]
        places = np.zeros((1, len(rows)), np.int64)
        for f, stride in zip(others, strides):  # unknown, known
            places = np.stack([places + boxes.sizes[f] * stride, places + rows[:, f] * stride], axis=1).reshape(-1, len(rows))
        values = np.concatenate([tables["without"].take(places), tables["with"].take(places)])
        phi[i : i + ROWS, [first, *others]] = (counts @ values).T
    return phi


def _from_tables(boxes: Boxes, df: DataFrame, key: str, features: str) -> DataFrame:
    """(key, phi). Rows meet by their bin of the sliced feature, those of a common bin in several tasks."""
    spark, first = df.sparkSession, boxes.sliced()[0]
    shared = spark.sparkContext.broadcast(tuple(vars(boxes).values()))

    @F.pandas_udf("array<int>")
    def binned(batch: pd.Series) -> pd.Series:
        return pd.Series(list(Boxes(*shared.value).bins_of(np.vstack(batch.to_numpy())).astype(np.int32)) if len(batch) else [], dtype=object)

    rows = materialize(df.select(F.col(key), binned(vector_to_array(features)).alias("bins"))).withColumns({
        "slice": F.col("bins")[first], "i": F.monotonically_increasing_id()})
    counts = {r["slice"]: r["count"] for r in rows.groupBy("slice").count().collect()}  # a row per bin of a feature
    units, start, pieces = 0, [], []
    for b in range(boxes.sizes[first]):
        start.append(units)
        pieces.append(-(-counts.get(b, 0) // PIECE_ROWS))
        units += pieces[-1]
    tasks = max(1, min(units, max(2 * spark.sparkContext.defaultParallelism, -(-sum(counts.values()) // PIECE_ROWS))))
    at = lambda values: F.array(*map(F.lit, values))[F.col("slice")]
    unit = at(start) + F.pmod(F.col("i"), at(pieces))
    dealt = rows.repartitionById(tasks, F.floor(unit * tasks / F.lit(max(units, 1))).cast("int")).sortWithinPartitions("slice")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = Boxes(*shared.value), {}
        for batch in batches:
            bins = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            edges = np.flatnonzero(np.diff(bins[:, first])) + 1
            parts = [table_attributions(own, part, tables) for part in np.split(bins, edges) if len(part)]
            phi = np.concatenate([p.ravel() for p in parts]) if parts else np.empty(0)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(own.cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(phi))], [key, "phi"])

    schema = rows.select(key, F.array(F.lit(0.0)).alias("phi")).schema
    return dealt.select(key, "bins").mapInArrow(answer, schema)


def forest_attribution(model, df: DataFrame, key: str, names: Sequence[str], features: str = "features") -> DataFrame:
    """(key, phi): per-row attribution of the positive class, averaged over the trees. Attributions
    plus the base value add up to the forest's probability. Features of few bins are answered from tables of all coalitions;
    where these would not fit, every row walks every tree."""
    trees = [tree_of(nodes) for nodes in forest_nodes(model, df.sparkSession)]
    boxes = boxes_of(trees, len(names))
    if boxes.table_bytes() <= TABLE_BYTES:
        found = _from_tables(boxes, df, key, features)
        return found.select(key, F.transform("phi", lambda p: p / len(trees)).alias("phi"))
    phi = attributions(df.sparkSession, vector_to_array(features), len(names), trees)
    return df.select(key, F.transform(phi, lambda p: p / len(trees)).alias("phi"))


def boosted_attribution(model: Boosted, df: DataFrame, key: str) -> DataFrame:
    """(key, phi): per-row attribution of the boosted score. Attributions, the trees' base values and the model's base
    add up to the score."""
    return df.select(key, attributions(df.sparkSession, numbers(model.features), len(model.features), model.trees).alias("phi"))


def attribution_summary(attributions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature: the ranking behind a summary plot."""
    one = attributions.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"f{i}") for i in range(len(names))])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"f{i}").alias("mean_abs")) for i, n in enumerate(names)
    ])).alias("r")).select("r.*")


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
