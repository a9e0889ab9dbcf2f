"""A vector index that is built once, kept as Parquet, and asked often; its answers are exact.

Vectors lie in cells around centres, one folder per batch and cell, sorted by the distance to their centre. A small table
holds the number of vectors and the range of these distances per batch and cell. A search first reads the cells nearest to each
query, which bounds its k-th distance, and then only those cells that can hold something nearer: by the range of distances
(triangle inequality) and by the plane half way between two centres. All other files are not opened.

A batch counts once its line is written, so a run that dies while it adds vectors leaves the index as it was.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_key
from ..session import materialize, small_side
from .neighbours import _pivot_distances, _ranked, _Search, _vectors

CENTRE_BYTES = 64 << 20  # of all centres together, which every task receives
SAMPLE_ROWS = 100_000  # vectors that the centres are fitted on
FILE_ROWS = 500_000  # vectors of one file, on average
BLOCK_ROWS = 20_000  # vectors, and queries, that one task compares at a time
DISTANCE_BYTES = 64 << 20
CELL_ROWS = "id bigint, v array<double>, far double"
HITS = "q bigint, neighbour_id bigint, distance double"


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows with a key and a vector of finite numbers; a key is a whole number."""
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{key} has to be a whole number")
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(odd, F.lit(False)))


def _one_length(rows: DataFrame, length: int | None = None) -> tuple[int, int]:
    """Number and length of the vectors; several lengths are an error."""
    r = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if r["n"] and (r["lo"] != r["hi"] or length not in (None, r["hi"])):
        raise ValueError("all vectors need one length")
    return r["n"], r["hi"] or 0


def _blocks(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``x`` and their distances to all centres, a bounded number at a time."""
    step = max(1, DISTANCE_BYTES // (8 * len(centres)))
    for lo in range(0, len(x), step):
        yield x[lo:lo + step], _pivot_distances(x[lo:lo + step], centres)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = [], []
                for _, d in _blocks(_vectors(batch.column(1)), shared.value):
                    cell.append(d.argmin(axis=1))
                    far.append(d[np.arange(len(d)), cell[-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.concatenate(far)), pa.array(np.concatenate(cell).astype(np.int32))],
                    names=["id", "v", "far", "cell"])

    return run


def build_index(df: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None) -> None:
    """Fit centres on a hash sample of at most ``SAMPLE_ROWS`` vectors, then store every vector in the cell of its nearest centre.

    ``cells`` defaults to the root of the number of vectors; all centres together stay below ``CENTRE_BYTES``. Rows without a
    key, or whose vector is NULL, empty or holds anything but finite numbers, take no part. Without any vector there is no
    index to build: ValueError.
    """
    rows = _clean(df, key, vector)
    n, length = _one_length(rows)
    if not n:
        raise ValueError("an index needs at least one vector")
    cells = min(cells or max(1, math.isqrt(n)), max(1, CENTRE_BYTES // (8 * length)), SAMPLE_ROWS // 10)
    sample = rows.orderBy(hash_key("id", seed="centre"), "id").limit(SAMPLE_ROWS).select(array_to_vector("v").alias("features"))
    if cells == 1 or n == 1:
        centres = [rows.orderBy("id").first()["v"]]
    else:
        model = KMeans(k=min(cells, n), seed=7, maxIter=5, initMode="random").fit(materialize(sample))
        centres = [c.tolist() for c in model.clusterCenters()]
    spark = df.sparkSession
    centres = np.unique(np.asarray(centres), axis=0).tolist()
    spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _store(rows, n, path, np.asarray(centres))


def append_index(df: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Add vectors under the centres the index has; nothing that is stored is read or rewritten. A key that is stored already
    becomes a second row."""
    centres = _centres(df.sparkSession, path)
    rows = _clean(df, key, vector)
    n, _ = _one_length(rows, centres.shape[1])
    if n:
        _store(rows, n, path, centres)


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return _vectors(spark.read.parquet(f"{path}/centres").orderBy("cell").select("centre").toArrow().column(0))


def _store(rows: DataFrame, n: int, path: str, centres: np.ndarray) -> None:
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    place = f"{path}/vectors/batch={batch}"
    placed = rows.mapInArrow(_assign(spark.sparkContext.broadcast(centres)), CELL_ROWS + ", cell int")
    # Ranges by cell and distance: a crowded cell becomes several files, a small one a single file.
    parts = max(1, math.ceil(n / FILE_ROWS), min(len(centres), spark.sparkContext.defaultParallelism))
    placed.repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id").write.partitionBy("cell").parquet(place)
    stored = spark.read.schema(CELL_ROWS + ", cell int").parquet(place)
    # Written last and as one file: from now on the batch counts.
    stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).select(
        F.lit(batch).alias("batch"), "cell", "n", "lo", "hi").coalesce(1).write.mode("append").parquet(f"{path}/layout")


def cell_layout(spark: SparkSession, path: str) -> DataFrame:
    """(batch, cell, n, lo, hi): a line per batch and cell."""
    return spark.read.parquet(f"{path}/layout")


def read_cells(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """(id, v, far, cell) of the given cells, in all batches; only their folders are listed and read."""
    lines = cell_layout(spark, path).where(F.col("cell").isin(cells)).select("batch", "cell").collect()
    if not lines:
        return spark.createDataFrame([], CELL_ROWS + ", cell int")
    folders = sorted(f"{path}/vectors/batch={r['batch']}/cell={r['cell']}" for r in lines)
    return spark.read.schema(CELL_ROWS + ", cell int").option("basePath", f"{path}/vectors").parquet(*folders).select("id", "v", "far", "cell")


def _first_cells(shared, fetch: int):
    """The nearest cells that together hold enough vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, _, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                found = []
                for _, far in _blocks(_vectors(batch.column(1)), centres):
                    far[:, sizes == 0] = np.inf
                    order = np.argsort(far, axis=1, kind="stable")
                    have = np.cumsum(sizes[order], axis=1)
                    need = np.minimum((have < fetch).sum(axis=1) + 1, (sizes > 0).sum())
                    found += [o[:m].astype(np.int32) for o, m in zip(order, need)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["q", "v", "cells"])

    return run


def _other_cells(shared):
    """The cells not yet seen that can hold a vector within the reach found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, low, high = shared.value
        held = np.isfinite(high)
        # Distances come from matrix products; the margins keep the bounds on the safe side of their rounding.
        scale = 1.0 + np.sqrt(np.einsum("ij,ij->i", centres, centres).max()) + high[held].max()
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch.column(2).to_pylist()
            reach = batch.column(3).to_numpy(zero_copy_only=False)
            found, at = [], 0
            for _, far in _blocks(_vectors(batch.column(1)), centres):
                home = far.argmin(axis=1)
                bases, which = np.unique(home, return_inverse=True)
                for b, base in enumerate(bases):
                    apart = _pivot_distances(centres[base:base + 1], centres)[0]
                    usable = apart > 1e-3 * scale
                    for i in np.flatnonzero(which == b):
                        row = far[i]
                        half = np.where(usable, (row ** 2 - row[base] ** 2) / (2 * np.where(usable, apart, 1.0)), 0.0)
                        floor = np.maximum(np.maximum(row - high, low - row), half)
                        open_ = held & (floor <= reach[at + i] + 1e-6 * (scale + row))
                        open_[seen[at + i]] = False
                        found.append((at + i, np.flatnonzero(open_).astype(np.int32)))
                at += len(far)
            found.sort(key=lambda f: f[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["q", "v", "cells"])

    return run


def _compare(fetch: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        search = _Search(_vectors(asked.column("v")), fetch)
        search.add(_vectors(held.column("v")), held.column("id").to_numpy())
        query, dist, ids = search.best
        return pa.table({"q": pa.array(asked.column("q").to_numpy()[query]), "neighbour_id": pa.array(ids), "distance": pa.array(dist)})

    return run


def _visit(visits: DataFrame, path: str, sizes: np.ndarray, fetch: int, block_rows: int) -> DataFrame:
    """The best ``fetch`` of every block of a visited cell per query. Crowded cells, and cells that many queries visit, are cut into
    blocks on either side."""
    spark = visits.sparkSession
    asking = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a line per cell
    if not asking:
        return spark.createDataFrame([], HITS)
    cuts = small_side(spark.createDataFrame(
        [(c, math.ceil(int(sizes[c]) / block_rows), math.ceil(n / block_rows)) for c, n in asking.items()], "cell int, held int, asked int"))
    left = visits.join(cuts, "cell").select(
        "q", "v", "cell", F.pmod(F.xxhash64("q"), F.col("asked")).cast("int").alias("asked_no"),
        F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("held_no"))
    right = read_cells(spark, path, sorted(asking)).join(cuts, "cell").select(
        "id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("held")).cast("int").alias("held_no"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("asked_no"))
    block = ["cell", "held_no", "asked_no"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_compare(fetch), HITS)


def search_index(queries: DataFrame, path: str, k: int = 1, query_id: str = "query_id", vector: str = "embedding",
                 exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the exact k nearest stored vectors by squared Euclidean distance, ties by id.

    Queries are rows of unique ids; those without a usable vector give nothing. With ``exclude_self`` the stored row with the
    query's id is left out. A distance is that of the vectors as doubles. Only files of visited cells are read.
    """
    spark = queries.sparkSession
    asked = _clean(queries, query_id, vector)
    centres = _centres(spark, path)
    n, _ = _one_length(asked, centres.shape[1])
    if not n:
        return spark.createDataFrame([], "q bigint, rank int, neighbour_id bigint, distance double").withColumnRenamed("q", query_id)
    fetch = k + 1 if exclude_self else k
    m = len(centres)
    sizes, low, high = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
    for r in cell_layout(spark, path).groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        sizes[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    shared = spark.sparkContext.broadcast((centres, sizes, low, high))

    first = materialize(asked.select(F.col("id").alias("q"), "v").mapInArrow(
        _first_cells(shared, fetch), "q bigint, v array<double>, cells array<int>"))
    near = _visit(first.select("q", "v", F.explode("cells").alias("cell")), path, sizes, fetch, block_rows)
    near = materialize(_ranked(near, "q", fetch))
    # Too few vectors in all: then every cell has been seen, and the reach does not matter.
    reach = near.groupBy("q").agg(F.sqrt(F.max("distance")).alias("reach"))
    more = materialize(first.join(reach, "q").select("q", "v", "cells", "reach").mapInArrow(
        _other_cells(shared), "q bigint, v array<double>, cells array<int>"))
    rest = _visit(more.select("q", "v", F.explode("cells").alias("cell")), path, sizes, fetch, block_rows)
    hits = near.drop("rank").unionByName(rest)
    if exclude_self:
        hits = hits.where(F.col("q") != F.col("neighbour_id"))
    return _ranked(hits, "q", k).withColumnRenamed("q", query_id)


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
