"""Approximate nearest neighbours by inner product, with a hierarchical k-means tree.

The tree is fitted on a bounded sample and small enough for every task; all vectors are dealt to its leaves. A query
walks the tree best bin first: it keeps the branches passed by in a priority queue and always goes on at the nearest
one, so leaves come in the order in which they are worth a visit. How many leaves a query visits is calibrated: for a
bounded number of stored vectors the exact neighbours are found by comparing them with all rows, and the visits are
widened until the leaves visited hold the asked share of them. A query whose leaves hold too few vectors goes on.

Inner products become distances by one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, which is 0 for
queries: the nearest point is then the one with the largest product. Equal vectors share a leaf. Only the ``k`` + 1
smallest ids of a vector can appear in a result, so no more of them are searched; that loses nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

SAMPLE = 20_000  # vectors that the tree is fitted on
BRANCHES = 8
LEAF_SAMPLE = 40  # vectors of the sample below which a node is not split
LEAF_SHARE = 32  # nor is a node that holds less than one in so many; more leaves cost more visits than they save
CALIBRATION = 200  # stored vectors used as queries to calibrate the visits
BLOCK_ROWS = 4096  # vectors of a leaf, and queries that visit it, compared in one step


# ---------------------------------------------------------------- tree

@dataclass
class Node:
    centre: np.ndarray
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """Hierarchical k-means; every fit of the same sample gives the same tree."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES, leaf_points: int | None = None, seed: int = 7):
        self.leaves = 0
        self.random = np.random.default_rng(seed)
        self.branches = branches
        self.leaf_points = max(LEAF_SAMPLE, len(points) // LEAF_SHARE) if leaf_points is None else leaf_points
        self.root = self._grow(points, points.mean(axis=0))

    def _grow(self, points: np.ndarray, centre: np.ndarray) -> Node:
        node = Node(centre)
        if len(points) > self.leaf_points:
            centres, label = self._split(points)
            if len(centres) > 1:
                node.children = [self._grow(points[label == i], c) for i, c in enumerate(centres)]
                return node
        node.leaf = self.leaves
        self.leaves += 1
        return node

    def _split(self, points: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(points, axis=0)
        centres = distinct[self.random.choice(len(distinct), min(self.branches, len(distinct)), replace=False)]
        for _ in range(rounds):
            label = nearest(points, centres)
            kept = np.unique(label)
            centres = np.stack([points[label == i].mean(axis=0) for i in kept])
        return centres, nearest(points, centres)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, going down to the nearest centre."""
        out = np.empty(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not node.children:
                out[rows] = node.leaf
            elif len(rows):
                label = nearest(points[rows], np.stack([c.centre for c in node.children]))
                todo += [(c, rows[label == i]) for i, c in enumerate(node.children)]
        return out

    def visits(self, point: np.ndarray, most: int, stored: Mapping[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and more until they hold ``least`` of the ``stored`` vectors."""
        found, queue, number, held = [], [(0.0, 0, self.root)], 0, 0
        while queue and (len(found) < most or held < least):
            _, _, node = heapq.heappop(queue)
            while node.children:
                far = ((np.stack([c.centre for c in node.children]) - point) ** 2).sum(axis=1)
                best = int(far.argmin())
                for i, child in enumerate(node.children):
                    if i != best:
                        number += 1
                        heapq.heappush(queue, (float(far[i]), number, child))
                node = node.children[best]
            found.append(node.leaf)
            held += stored.get(node.leaf, 0) if stored else 0
        return found


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, ties to the first; in steps, so memory stays small."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(points[i : i + 8192] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 8192)] or [np.empty(0, int)])


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Stored vectors with the coordinate that makes their norms equal."""
    rest = np.sqrt(np.maximum(0.0, norm**2 - (vectors**2).sum(axis=1)))
    return np.column_stack([vectors, rest])


# ---------------------------------------------------------------- rows

def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): ids as long and vectors of double. Null keys and vectors that are null, zero, empty or hold a null, NaN or
    infinite component are left out, and so are vectors whose length differs from the commonest one."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    rows = rows.where("v IS NOT NULL")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of the vectors for every query, its own id left out: (query_id, id, score). A product is taken again
    pair by pair for whatever may be among the best, so equal vectors have equal scores wherever they lie."""
    rough = queries @ vectors.T
    slack = 1e-9 * np.sqrt((queries**2).sum(axis=1) * (vectors**2).sum(axis=1).max())
    wanted = min(len(ids), k + 1)  # one may be the query itself
    least = np.partition(rough, len(ids) - wanted, axis=1)[:, len(ids) - wanted] - slack
    q, v = np.nonzero(rough >= least[:, None])
    keep = query_ids[q] != ids[v]
    q, v = q[keep], v[keep]
    score = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.empty(0)])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    best = np.arange(len(q)) - first[q] < k
    return pd.DataFrame({"query_id": query_ids[q[best]], "id": ids[v[best]], "score": score[best]})


HITS = "query_id bigint, id bigint, score double"


def merge(hits: DataFrame, k: int) -> DataFrame:
    """The best k per query, with rank from 1; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_nearest(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Nearest rows of a bounded set of queries (id, v), sent to every task, by comparing them with all rows in blocks."""
    q, q_ids = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy("int64")

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in batches:
            for i in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[i : i + BLOCK_ROWS]
                found = top(q, q_ids, matrix(part["v"]), part["id"].to_numpy("int64"), k)
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return merge(rows.select("id", "v").mapInPandas(compare, HITS), k)


# ---------------------------------------------------------------- index and search

@dataclass
class Index:
    """``vectors``: (id, v, leaf) of all rows, without needless copies; ``visits``: calibrated leaves per query; ``stored``: vectors of
    each leaf."""

    tree: Tree
    vectors: DataFrame
    visits: int
    recall: float
    stored: Mapping[int, int]


def build(rows: DataFrame, k: int, recall: float = 0.97, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Index | None:
    """Index of (id, v) rows as ``clean_vectors`` gives them; None without rows. The tree's size follows the sample, so
    leaves grow with the table; they are searched in blocks."""
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if norm is None:
        return None
    drawn = rows.withColumn("_draw", F.xxhash64("id", F.lit("tree"))).orderBy("_draw", "id").limit(sample).select("id", "v").toPandas()
    tree = Tree(lift(np.stack(drawn["v"].to_numpy()), norm))

    @F.pandas_udf("int")
    def leaf_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(lift(np.stack(vectors.to_numpy()), norm)))

    same = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1)
    vectors = materialize(kept.select("id", "v", leaf_of("v").alias("leaf")))
    asked = drawn.head(calibration)
    truth = exact_nearest(vectors, asked, k).join(vectors.select("id", "leaf"), "id").select("query_id", "leaf").toPandas()
    point = dict(zip(asked["id"], asked["v"]))
    turn = np.zeros(tree.leaves + 1)
    for query, leaves in truth.groupby("query_id")["leaf"]:
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(np.append(point[query], 0.0), tree.leaves))}
        np.add.at(turn, [place[leaf] for leaf in leaves], 1)
    reached = np.cumsum(turn) / max(1.0, turn.sum())
    visits = max(1, int(np.argmax(reached >= recall))) if turn.sum() else 1
    stored = {r["leaf"]: r["count"] for r in vectors.groupBy("leaf").count().collect()}
    return Index(tree, vectors, visits, float(reached[visits]), stored)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) for every query (id, v), its own id left out; fewer than ``k`` where the table has fewer.

    A leaf's vectors and the queries that visit it meet block by block, so neither side of a crowded leaf is gathered.
    """
    tree, visits, stored_of = index.tree, index.visits, index.stored

    @F.pandas_udf("array<int>")
    def walk(vectors: pd.Series) -> pd.Series:
        return pd.Series([tree.visits(np.append(v, 0.0), visits, stored_of, k + 1) for v in vectors])

    stored = _blocks(index.vectors, "id", "v_parts", "v_part")
    asked = materialize(queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.explode(walk("v")).alias("leaf")))
    asked = _blocks(asked, "q_id", "q_parts", "q_part")
    sizes = lambda df, parts: df.select("leaf", parts).distinct()
    left = stored.join(F.broadcast(sizes(asked, "q_parts")), "leaf").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    right = asked.join(F.broadcast(sizes(stored, "v_parts")), "leaf").withColumn("v_part", F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1)))
    keys = ["leaf", "v_part", "q_part"]

    def compare(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return top(matrix(asked["q_v"]), asked["q_id"].to_numpy("int64"), matrix(vectors["v"]), vectors["id"].to_numpy("int64"), k)

    hits = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "q_id", "q_v").groupBy(*keys)).applyInPandas(compare, HITS)
    return merge(hits, k).select("query_id", "rank", "id", "score")


def _blocks(df: DataFrame, key: str, parts: str, part: str) -> DataFrame:
    """Deals the rows of every leaf into parts of about BLOCK_ROWS. Leaves are bounded by the tree."""
    sizes = df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(parts))
    return df.join(F.broadcast(sizes), "leaf").withColumn(part, F.pmod(F.xxhash64(key), F.col(parts)).cast("int"))


def nearest_neighbours(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found for every row that ``is_query`` (over ``id``) marks.

    Nearness is the inner product in double precision of the original vectors; ties go to the smaller id. A row without
    a usable vector (see ``clean_vectors``) takes no part; of rows that repeat a key one takes part. An empty table gives
    no rows; a query gets fewer than ``k`` only where there are fewer others.
    """
    rows = materialize(clean_vectors(df, key, vector).groupBy("id").agg(F.min("v").alias("v")))
    index = build(rows, k, recall)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    return search(index, rows.where(is_query), k)
