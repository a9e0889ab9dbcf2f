"""Means, deviations and correlations of all pairs of columns from one pass.

Tasks turn batches of rows into blocks of sums, one matrix product per block, and merge them by the update of Chan, Golub
and LeVeque, which keeps its digits where means are large against deviations. One line per column leaves a task; lines
of one column meet in one task, which merges them as they come and holds one line.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per ordered pair: rows where both are known, mean and squared deviations of either column over them, co-moment.
FIELDS = ("n", "mean_a", "mean_b", "dev_a", "dev_b", "co")
BLOCK_ROWS = 4096


def _block(x: np.ndarray) -> list[np.ndarray]:
    """The fields of every pair over one block of rows; NaN is a missing value."""
    known = ~np.isnan(x)
    m = known.astype(np.float64)
    shift = np.where(known, x, 0).sum(0) / np.maximum(m.sum(0), 1)
    v = np.where(known, x - shift, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1)
    mean = (v.T @ m) / some  # of the row's column over the rows where the other one is known, too
    dev = np.maximum((v * v).T @ m - n * mean * mean, 0)
    co = v.T @ v - n * mean * mean.T
    return [n, mean + shift[:, None], (mean + shift[:, None]).T, dev, dev.T, co]


def _merge(one: Sequence[np.ndarray], two: Sequence[np.ndarray]) -> list[np.ndarray]:
    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1)
    da, db = two[1] - one[1], two[2] - one[2]
    both = one[0] * share
    return [n, one[1] + da * share, one[2] + db * share, one[3] + two[3] + da * da * both, one[4] + two[4] + db * db * both,
            one[5] + two[5] + da * db * both]


def _lines(total: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    order = sorted(total)
    arrays = [pa.array([total[i][f] for i in order], pa.list_(pa.float64())) for f in range(len(FIELDS))]
    return pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), *arrays], ["a", *FIELDS])


def comoments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, n, mean_a, mean_b, dev_a, dev_b, co): a line per column position, with an array over all columns. NULL and NaN are
    missing; a pair counts the rows where both are known."""
    width = len(cols)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            for at in range(0, len(x), BLOCK_ROWS):
                block = _block(x[at:at + BLOCK_ROWS])
                total = block if total is None else _merge(total, block)
        for i in range(width if total is not None else 0):
            yield _lines({i: [field[i] for field in total]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            fields = [batch.column(f) for f in FIELDS]
            for row, i in enumerate(batch.column("a").to_pylist()):
                line = [f[row].values.to_numpy() for f in fields]
                total[i] = _merge(total[i], line) if i in total else line
        if total:
            yield _lines(total)

    schema = "a int, " + ", ".join(f"{f} array<double>" for f in FIELDS)
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # One row without values adds nothing and gives an empty table its lines.
    x = x.unionByName(df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in x.columns]))
    return x.mapInArrow(sums, schema).repartition("a").mapInArrow(merged, schema)


def correlations(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) for all ordered pairs; NULL where a column is constant or no row knows both."""
    names = F.array(*[F.lit(c) for c in cols])

    def name(at: Column) -> Column:
        return F.element_at(names, at + 1)

    pairs = lines.select("a", F.posexplode(F.arrays_zip(*FIELDS)).alias("b", "s"))
    corr = F.try_divide(F.col("s.co"), F.sqrt(F.col("s.dev_a")) * F.sqrt(F.col("s.dev_b")))
    inside = F.when(corr.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)))  # rounding may leave it
    return pairs.select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b"), inside.alias("corr"))


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
