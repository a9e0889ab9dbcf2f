"""Helpers shared by the operators: hot keys, empty-safe text, block iteration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

HOT_SHARE = 1000  # a key is hot when it holds more than one row in so many; at most so many keys can
HOT_ROWS = 1000  # and never below so many rows

BATCH_ROWS, BATCH_BYTES = 200, 64_000_000
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lets at most BATCH_ROWS texts and about BATCH_BYTES travel to Python at once. Spark's default of 10,000 long texts,
    with what functions make of them, takes hundreds of megabytes per worker, and idle workers keep theirs. Smaller
    settings of the session stay."""
    for name, most in BATCH_SETTINGS.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def text_of(column: str | Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def blocks(texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text is a block of its own. Null counts as empty."""
    block, held = [], 0
    for text in texts:
        text = text or ""
        if block and held + len(text) > chars:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` in a global order, written once, with their places in it from 0. They are sorted by ranges, so no task
    takes more than its share; only the sizes of the parts are collected."""
    held = materialize(rows.orderBy(*order))
    sizes = dict(held.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    first = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.shiftright("_place", 33).cast("int") + 1)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_place", F.monotonically_increasing_id()).withColumn(name, first + within).drop("_place")


def one_of_each(rows: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """One row of those that agree in ``keys``. Rows only move if the caller has found that there are ``repeated`` ones."""
    if not repeated:
        return rows
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    return rows.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: str) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which holds one row per key and the key's number of rows in ``size``.

    Hot keys are bounded by arithmetic: no more than ``n_rows / limit`` keys can hold over ``limit`` rows, so their
    groups are broadcast. Their rows then take part in the shuffle under a key made of ``spread``, which no group has.
    Both sides must hold the key as string.
    """
    spark = rows.sparkSession
    values = [c for c in groups.columns if c != key]
    limit = max(HOT_ROWS, n_rows // HOT_SHARE)
    hot = groups.where(F.col(size) > limit).collect()
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_group_key"), *[F.col(c).alias(f"_c_{c}") for c in values])
    if not hot:
        joined = rows.join(cold, F.col(key) == F.col("_group_key"), "left")
        return joined.select(*rows.columns, *[F.col(f"_c_{c}").alias(c) for c in values])
    found = spark.createDataFrame(hot, groups.schema).select(
        F.col(key).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    rows_ = rows.join(F.broadcast(found), F.col(key) == F.col("_hot"), "left").withColumn(
        "_own", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("#"), F.col(spread).cast("string"))))
    joined = rows_.join(cold, F.col("_own") == F.col("_group_key"), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])
