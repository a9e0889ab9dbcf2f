"""Exact nearest neighbours by squared Euclidean distance, and oversampling built on them.

Few queries: the corpus is scanned where it lies. Every task compares its vectors with a block of
queries it received by broadcast and sends on the best ``k`` per query.

Many queries: both sides are cut into cells around pivot vectors. The triangle inequality bounds
how far a query's k-th neighbour can be, so a query visits only cells that can hold a nearer one
(Lu, Shen, Chen and Ooi, 2012). Identical vectors are searched once, and crowded cells are cut into
blocks, so neither copies nor clusters end up in one task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_int, hash_key, hash_long
from ..session import materialize
from .ordering import dense_codes

QUERY_BLOCK_BYTES = 32 << 20
MAX_SCANS = 4
TILE_ROWS, TILE_QUERIES = 2048, 512


# ---------------------------------------------------------------- inside a task

def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _best(query: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int):
    """Keep the k smallest (distance, id) of every query."""
    order = np.lexsort((ids, dist, query))
    query, dist, ids = query[order], dist[order], ids[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return query[keep], dist[keep], ids[keep]


def _candidates(points: np.ndarray, queries: np.ndarray, k: int, worst: np.ndarray):
    """Pairs that may be among the k nearest: matrix-product distances with room for rounding."""
    p2, q2 = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", queries, queries)
    rough = p2[:, None] + q2[None, :] - 2.0 * (points @ queries.T)
    slack = 1e-11 * (p2.max() + q2) + 1e-300
    bound = np.partition(rough, k - 1, axis=0)[k - 1] if len(points) >= k else np.full(len(queries), np.inf)
    return np.nonzero(rough <= np.minimum(bound, worst) + slack)


def _exact(points: np.ndarray, queries: np.ndarray, pi: np.ndarray, qi: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Squared distances of the candidate pairs, a slice at a time: copies can make every pair one."""
    out = np.empty(len(pi))
    for lo in range(0, len(pi), step):
        diff = points[pi[lo:lo + step]] - queries[qi[lo:lo + step]]
        out[lo:lo + step] = np.sum(diff * diff, axis=1)
    return out


class _Search:
    """The k best rows so far for every query of a block."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.worst = np.full(len(queries), np.inf)

    def add(self, points: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.queries), self.k
        for lo in range(0, len(ids), TILE_ROWS):
            tile, tile_ids = points[lo:lo + TILE_ROWS], ids[lo:lo + TILE_ROWS]
            found = [self.best]
            for q in range(0, n, TILE_QUERIES):
                part = self.queries[q:q + TILE_QUERIES]
                pi, qi = _candidates(tile, part, k, self.worst[q:q + TILE_QUERIES])
                found.append((qi + q, _exact(tile, part, pi, qi), tile_ids[pi]))
            self.best = _best(*[np.concatenate(x) for x in zip(*found)], k)
            query, dist, _ = self.best
            last = np.r_[query[1:] != query[:-1], True]
            tail = np.full(n, np.inf)
            tail[query[last]] = dist[last]
            self.worst = np.where(np.bincount(query, minlength=n) >= k, tail, np.inf)


def _scan(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = block.value
        search = _Search(queries, k)
        for batch in batches:
            if batch.num_rows:
                search.add(_vectors(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False))
        query, dist, ids = search.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[query]), pa.array(ids), pa.array(dist)], names=["q", "neighbour_id", "distance"])

    return run


# ---------------------------------------------------------------- searching

def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = 1, query_id: str = "query_id", corpus_id: str = "id",
    vector: str = "embedding", exclude_self: bool = False,
    block_bytes: int = QUERY_BLOCK_BYTES, max_scans: int = MAX_SCANS,
) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the exact k nearest corpus rows, ties by id.

    Ids are of any type that can be ordered, and all vectors have one length. The bytes of the queries are checked:
    up to ``max_scans`` blocks of ``block_bytes`` are broadcast, one corpus scan each; more queries
    than that are routed to cells. ``exclude_self`` leaves out the corpus row with the query's id.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(d.schema[c].dataType, whole) for d, c in ((queries, query_id), (corpus, corpus_id))):
        return _by_number(queries, corpus, k, query_id, corpus_id, vector, exclude_self, block_bytes, max_scans)
    spark = corpus.sparkSession
    fetch = k + 1 if exclude_self else k
    scanned = corpus.where(F.col(vector).isNotNull()).select(
        F.col(corpus_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = math.ceil(size["n"] * (size["d"] or 0) * 8 / block_bytes)
    if blocks > max_scans:
        hits = _routed(asked, scanned, fetch)
    else:
        hits = _scanned(spark, asked, scanned, fetch, max(blocks, 1))
    hits = hits.withColumnRenamed("q", query_id)
    if exclude_self:
        hits = hits.where(F.col(query_id) != F.col("neighbour_id"))
    return _ranked(hits, query_id, k)


def _by_number(queries, corpus, k, query_id, corpus_id, vector, exclude_self, block_bytes, max_scans) -> DataFrame:
    """The search on dense numbers in the order of the ids, so ties stay ties by id."""
    ids = corpus.select(F.col(corpus_id).alias("value")).union(queries.select(F.col(query_id).alias("value")))
    numbers = materialize(dense_codes(ids, "value"))
    of = lambda d, c: d.join(numbers, F.col(c) == F.col("value")).select(F.col("code").alias("_id"), vector)
    hits = nearest(of(queries, query_id).withColumnRenamed("_id", "_query"), of(corpus, corpus_id), k, "_query", "_id", vector,
                   exclude_self, block_bytes, max_scans)
    names = lambda code, name: numbers.select(F.col("code").alias(code), F.col("value").alias(name))
    hits = hits.withColumnRenamed("neighbour_id", "_found")
    return hits.join(names("_query", query_id), "_query").join(names("_found", "neighbour_id"), "_found").select(
        query_id, "rank", "neighbour_id", "distance")


def _ranked(hits: DataFrame, query: str, k: int) -> DataFrame:
    """The k best per query; Spark drops rows beyond k per task before it shuffles them."""
    w = Window.partitionBy(query).orderBy("distance", "neighbour_id")
    return (
        hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select(query, "rank", "neighbour_id", "distance")
    )


def _scanned(spark, asked: DataFrame, scanned: DataFrame, fetch: int, blocks: int) -> DataFrame:
    parts = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        table = mine.orderBy("id").toArrow()  # about block_bytes, as checked
        if table.num_rows:
            block = spark.sparkContext.broadcast((table.column("id").to_numpy(), _vectors(table.column("v"))))
            parts.append(scanned.mapInArrow(_scan(block, fetch), "q bigint, neighbour_id bigint, distance double"))
    if not parts:
        return spark.createDataFrame([], "q bigint, neighbour_id bigint, distance double")
    return reduce(DataFrame.unionByName, parts)


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    gap = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(gap, 0.0))


def _assign(pivots):
    """Adds the cell (nearest pivot) and the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _pivot_distances(_vectors(batch.column(0)), pivots.value)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                names=["v", "ids", "cell", "far"])

    return run


def _route(layout, fetch: int):
    """Adds the cells a query has to visit.

    With the ``fetch`` smallest pivot distances of every cell known, the ``fetch``-th smallest sum
    of query-to-pivot and pivot-to-member distance bounds the answer from above. A cell whose
    members are all farther than that, by their distance range, needs no visit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, low, high, near = layout.value
        # Matrix-product distances carry rounding; the margin keeps the bounds on the safe side.
        scale = 1e-6 * (1.0 + np.abs(pivots).max() * math.sqrt(pivots.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _pivot_distances(_vectors(batch.column(1)), pivots)
            visits = []
            for row in far:
                sums = (row[:, None] + near).ravel()
                reach = np.partition(sums, fetch - 1)[fetch - 1] if len(sums) >= fetch else np.inf
                floor = np.maximum(row - high, low - row)
                visits.append(np.flatnonzero(floor <= reach + scale + 1e-6 * row).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(visits, pa.list_(pa.int32()))], names=["q", "v", "cells"])

    return run


def _search_block(fetch: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()),
                          "distance": pa.array([], pa.float64())})
        if not asked.num_rows or not held.num_rows:
            return empty
        copies = held.column("ids").to_pylist()
        search = _Search(_vectors(asked.column("v")), fetch)
        first = np.asarray([c[0] for c in copies])
        search.add(_vectors(held.column("v")), first)
        query, dist, ids = search.best
        at = {i: c for i, c in zip(first.tolist(), copies)}
        members = [at[i] for i in ids.tolist()]
        spread = [len(m) for m in members]
        query, dist, ids = _best(np.repeat(query, spread), np.repeat(dist, spread),
                                 np.asarray([i for m in members for i in m], np.int64), fetch)
        return pa.table({"q": pa.array(asked.column("q").to_numpy()[query]), "neighbour_id": pa.array(ids),
                         "distance": pa.array(dist)})

    return run


def _routed(asked: DataFrame, scanned: DataFrame, fetch: int, pivots: int | None = None,
            block_rows: int = 20_000) -> DataFrame:
    spark = scanned.sparkSession
    # Identical vectors become one row with their smallest ids, which is all a query can return.
    by_vector = Window.partitionBy("v").orderBy("id")
    corpus = (
        scanned.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= fetch)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    if pivots is None:
        pivots = min(2000, max(1, math.isqrt(scanned.count())))
    drawn = scanned.orderBy(hash_key("id", seed="pivot"), "id").limit(pivots).select("v").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "q bigint, neighbour_id bigint, distance double")
    centres = np.unique(_vectors(drawn.column("v")), axis=0)
    cells = materialize(corpus.mapInArrow(
        _assign(spark.sparkContext.broadcast(centres)), "v array<double>, ids array<bigint>, cell int, far double"))

    # Per cell: its size, its range of pivot distances and the smallest of them. One row per pivot.
    inner = Window.partitionBy("cell").orderBy("far", F.col("ids")[0])
    closest = (
        cells.select("cell", "far", "ids").withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= fetch)
        .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near"))
    )
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    rows = sizes.join(closest, "cell").collect()
    m = len(centres)
    low, high, near = np.full(m, np.inf), np.full(m, -np.inf), np.full((m, fetch), np.inf)
    for r in rows:
        low[r["cell"]], high[r["cell"]] = r["lo"], r["hi"]
        near[r["cell"], :len(r["near"])] = r["near"]
    layout = spark.sparkContext.broadcast((centres, low, high, near))

    different = asked.groupBy("v").agg(F.min("id").alias("q")).select("q", "v")
    routed = materialize(different.mapInArrow(_route(layout, fetch), "q bigint, v array<double>, cells array<int>"))
    visits = routed.select("q", "v", F.explode("cells").alias("cell"))
    asking = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cuts = spark.createDataFrame(
        [(r["cell"], math.ceil(r["n"] / block_rows), math.ceil(asking.get(r["cell"], 0) / block_rows)) for r in rows],
        "cell int, held int, asked int").where("asked > 0")  # one row per pivot

    key = ["cell", "held_no", "asked_no"]
    left = visits.join(cuts, "cell").select(
        "q", "v", "cell", F.pmod(F.xxhash64("q"), F.col("asked")).cast("int").alias("asked_no"),
        F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("held_no"))
    right = cells.join(cuts, "cell").select(
        "v", "ids", "cell", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("held")).cast("int").alias("held_no"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("asked_no"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _search_block(fetch), "q bigint, neighbour_id bigint, distance double")
    best = _ranked(found, "q", fetch).withColumnRenamed("q", "_q")
    return (
        asked.join(different.withColumnRenamed("q", "_q"), "v").select("id", "_q").join(best, "_q")
        .select(F.col("id").alias("q"), "neighbour_id", "distance")
    )


def smote(
    df: DataFrame, key: str, label: str, features: list[str], minority: int = 1, k: int = 5, seed: int = 30,
) -> DataFrame:
    """Originals plus synthetic minority rows until the classes are even.

    A synthetic row lies between a minority row and one of its ``k`` nearest minority rows; base,
    neighbour and position are hash draws of the synthetic row's number. Columns: key (NULL for
    synthetic rows), label, features, ``synthetic`` 0/1. With fewer than ``k`` other minority rows
    all of them are used; with none, nothing can be interpolated and the query fails.
    """
    rows = df.select(key, label, *[F.col(f).cast("double").alias(f) for f in features])
    counts = rows.agg(F.count_if(F.col(label) == minority).alias("few"), F.count(label).alias("all")).first()
    few, need = counts["few"], counts["all"] - 2 * counts["few"]
    originals = rows.withColumn("synthetic", F.lit(0))
    if need <= 0:
        return originals
    if few < 2:
        raise ValueError("need at least two minority rows")
    k = min(k, few - 1)
    small = rows.where(F.col(label) == minority).select(F.col(key).alias("id"), F.array(*features).alias("embedding"))
    near = nearest(small.withColumnRenamed("id", "query_id"), small, k, exclude_self=True)
    numbered = dense_codes(small, "id").join(small.withColumnRenamed("id", "value"), "value")

    draws = df.sparkSession.range(need).select(
        (hash_long("id", F.lit("base"), seed=seed) % few).alias("code"),
        (hash_int("id", F.lit("near"), seed=seed) % k + 1).cast("int").alias("rank"),
        (hash_int("id", F.lit("step"), seed=seed) / F.lit(4294967296.0)).alias("u"))
    other = small.select(F.col("id").alias("neighbour_id"), F.col("embedding").alias("other"))
    made = (
        draws.join(numbered, "code")
        .join(near.withColumnRenamed("query_id", "value"), ["value", "rank"])
        .join(other, "neighbour_id")
        .select(
            F.lit(None).cast(df.schema[key].dataType).alias(key),
            F.lit(minority).cast(df.schema[label].dataType).alias(label),
            *[(F.col("embedding")[i] + F.col("u") * (F.col("other")[i] - F.col("embedding")[i])).alias(f)
              for i, f in enumerate(features)],
            F.lit(1).alias("synthetic"))
    )
    return originals.unionByName(made)


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
