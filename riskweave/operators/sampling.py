"""Repeatable splits and folds. Every draw is a hash of the row key and a seed, so it does not
depend on partitioning, row order or retries, and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_int, hash_long
from .selection import TASK_ROWS, select_ranks


def random_split(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Mark about ``frac`` of the rows."""
    return df.withColumn(out, (hash_int(key, seed=seed) < F.lit(round(frac * 4294967296))).cast("int"))


def validation_tail(df: DataFrame, key: str, frac: float = 0.2, seed: int = 7, out: str = "is_val") -> DataFrame:
    """Hold out a fraction of the training rows. Row position means nothing on a cluster, so the
    held-out rows are drawn by key."""
    return random_split(df, key, frac, seed, out)


def group_split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.125, seed: int = 42,
                out: str = "part") -> DataFrame:
    """train / val / test by group key, so no group is in two parts. ``val`` is a share of what
    the test part leaves."""
    h = hash_int(key, seed=seed)
    scale = 4294967296
    return df.withColumn(out, F.when(h < F.lit(round(test * scale)), F.lit("test"))
                         .when(h < F.lit(round((test + (1 - test) * val) * scale)), F.lit("val"))
                         .otherwise(F.lit("train")))


def kfold(df: DataFrame, key: str, k: int = 3, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, (hash_int(key, seed=seed) % k).cast("int"))


def stratified_split(
    df: DataFrame, key: str, label: str, frac: float = 0.2, seed: int = 42, out: str = "is_test", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Mark exactly ``round(frac * n)`` rows of every class: those with the smallest hashes of their key.

    Where the quota ends between rows of one key, those with the smallest hashes of all their columns are marked (maps
    left out); where it ends between equal rows, as many of them as are missing. NULL is a class of its own.

    No class is ever sorted: hashes are counted by leading digits until the edge fits a task, which gives one threshold
    per class. The rows are then compared with it, without a shuffle unless there are very many classes.
    """
    h, whole = hash_long(key, seed=seed), F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
    quota = lambda n: F.array(F.floor(F.lit(frac) * n + F.lit(0.5)))
    h = F.coalesce(h, F.lit(-1).cast("bigint"))
    edge = select_ranks(df.select(F.col(label).alias("g"), h.alias("key")), quota, task_rows)
    edge = edge.select(F.col("g").alias("_label"), F.col("key").alias("_last"), (F.col("rank") - F.col("below")).alias("_left"),
                       "equal")
    rows = df.withColumn("_h", h).join(edge, F.col(label).eqNullSafe(F.col("_label")), "left")
    marked = F.coalesce((F.col("_h") <= F.col("_last")).cast("int"), F.lit(0))
    torn = edge.where(F.col("_left") < F.col("equal"))
    if torn.isEmpty():
        return rows.select(*df.columns, marked.alias(out))

    # The quota of some class ends between rows of one key: the same again over whole rows.
    at_edge = (F.col("_h") == F.col("_last")) & (F.col("_left") < F.col("equal"))
    tied = rows.where(at_edge).select(F.col(label).alias("g"), whole.alias("key"))
    inner = select_ranks(tied, torn.select(F.col("_label").alias("g"), F.col("_left").alias("rank")), task_rows)
    inner = inner.select(F.col("g").alias("_tied"), F.col("key").alias("_last_row"),
                         (F.col("rank") - F.col("below")).alias("_copies"), F.col("equal").alias("_of"))
    rows = rows.withColumn("_row", F.when(F.coalesce(at_edge, F.lit(False)), whole)).join(
        inner, F.col(label).eqNullSafe(F.col("_tied")), "left")
    marked = F.when(F.col("_row").isNull(), marked).otherwise((F.col("_row") <= F.col("_last_row")).cast("int"))
    split = F.coalesce((F.col("_row") == F.col("_last_row")) & (F.col("_copies") < F.col("_of")), F.lit(False))
    whole_rows = rows.where(~split).select(*df.columns, marked.alias(out))
    copies = rows.where(split).groupBy(*df.columns, "_copies").agg(F.count("*").alias("_n"))
    number = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i")
    return whole_rows.unionByName(copies.select(*df.columns, "_copies", number).select(
        *df.columns, (F.col("_i") <= F.col("_copies")).cast("int").alias(out)))
