"""Isolation forest (Liu, Ting and Zhou, 2008): rows that random splits separate early are odd."""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key, hash_unit
from ..operators.profile import minmax_normalize
from ..session import shared_dir

TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, path array<double>"


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` keys; puts leaves of many rows deeper."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def levels(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a full binary heap of ``limit`` levels: split feature and cut per inner node, path
    length per bottom slot. A branch that ends early sends every row down its left edge."""
    inner = 2 ** limit - 1
    feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
    path = np.zeros(inner + 1)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        at, depth, rows = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            for _ in range(limit - depth):
                at = 2 * at + 1
            path[at - inner] = depth + expected_path(len(rows))
            continue
        f = int(rng.choice(open_features))
        c = float(rng.uniform(lo[f], hi[f]))
        if c >= hi[f]:  # neighbouring floats can round up to the end, which would leave a side empty
            c = float(lo[f])
        feature[at], cut[at] = f, c
        below = x[rows, f] <= c
        todo += [(2 * at + 1, depth + 1, rows[below]), (2 * at + 2, depth + 1, rows[~below])]
    return feature, cut, path


@dataclass
class IsolationForestModel:
    """Grown trees. Their size is set by trees * sample, whatever the data's size."""

    spark: SparkSession
    features: list[str]
    trees: list[tuple]
    sample: int

    def score(self, df: DataFrame, out: str = "anomaly") -> DataFrame:
        """Add 2^(-mean depth / expected depth): near 1 is odd, well below 0.5 is ordinary."""
        grown = [tuple(np.asarray(part) for part in t[1:]) for t in self.trees]
        shared = self.spark.sparkContext.broadcast(grown)
        depth, norm = levels(self.sample), expected_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = shared.value
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=float)
                    continue
                x = np.vstack(batch.to_numpy())
                flat, rows, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
                for feature, cut, path in trees:
                    at = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        right = flat.take(rows + feature.take(at)) > cut.take(at)
                        at = 2 * at + 1 + right
                    total += path.take(at - len(cut))
                yield pd.Series(np.exp2(-total / len(trees) / norm))

        vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features])
        return df.withColumn(out, isolation(vector))

    def flag(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Scores scaled to [0, 1] over the scored rows, and 1 where that exceeds the threshold. The
        scored rows are written once to the shared folder, as walking the trees a second time for the bounds costs more; in
        columns, so that the bounds read the scores alone and a later selection what it needs."""
        path = f"{shared_dir(self.spark)}/scored-{uuid.uuid4().hex}"
        self.score(df).write.parquet(path)
        scaled = minmax_normalize(self.spark.read.parquet(path), "anomaly", "iso_score")
        return scaled.withColumn("iso_flag", (F.col("iso_score") > threshold).cast("int")).drop("anomaly")

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.trees, TREE_SCHEMA)

    def save(self, path: str) -> None:
        self.frame().withColumn("sample", F.lit(self.sample)).withColumn(
            "features", F.array(*[F.lit(f) for f in self.features])).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        rows = spark.read.parquet(path).orderBy("tree").collect()  # one row per tree
        return IsolationForestModel(spark, list(rows[0]["features"]), [tuple(r)[:4] for r in rows], rows[0]["sample"])


def fit_isolation_forest(
    df: DataFrame, key: str, features: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42
) -> IsolationForestModel:
    """Grow ``trees`` trees on ``sample`` hash-drawn rows each; trees grow in parallel tasks.

    A hash bound cuts the table down to about twice the ``trees * sample`` rows needed before any
    sort, so the one ordered window below has a fixed size. A small table is reused in several hash
    orders; within a tree no row appears twice.
    """
    n = df.count()
    if n == 0:
        raise ValueError("cannot fit on no rows")
    sample = min(sample, n)
    pool_size = min(n, trees * sample)
    per_copy = max(1, pool_size // sample)
    copies = math.ceil(trees / per_copy)
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    pool = df.select(F.col(key).alias("key"), vector.alias("x"))
    if n > 2 * pool_size:
        # Not the hash of the key alone: a split by that hash and the same seed may have taken all of the smallest away.
        pool = pool.where(hash_unit("key", F.lit("pool"), seed=seed) < F.lit(2.0 * pool_size / n))
    order = Window.partitionBy("copy").orderBy("h", "key")
    dealt = (
        pool.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("h", hash_key("key", "copy", seed=seed))
        .withColumn("slot", F.floor((F.row_number().over(order) - 1) / F.lit(sample)).cast("int"))
        .where(F.col("slot") < per_copy)
        .withColumn("tree", (F.col("copy") * per_copy + F.col("slot")).cast("int"))
        .where(F.col("tree") < trees)
    )
    limit = levels(sample)

    def grow(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf.sort_values(["h", "key"])["x"].to_numpy())
        parts = _grow(x, np.random.default_rng([seed, int(group[0])]), limit)
        return pd.DataFrame([[int(group[0]), *parts]], columns=["tree", "feature", "threshold", "path"])

    # A fixed number of tasks: by size alone the few sampled rows would be merged into one.
    tasks = min(trees, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grown = dealt.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    return IsolationForestModel(df.sparkSession, list(features), [tuple(r) for r in grown], sample)


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
