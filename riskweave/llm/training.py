"""Labelled rows to fit classifiers on: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
BROADCAST_ROWS = 1_000_000  # labelled keys that are sent to all tasks; more are joined as Spark sees fit


def _labelled(labels: DataFrame, key: str, label: str, where: Column | None) -> DataFrame:
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    return (told.where(where) if where is not None else told).groupBy(key).agg(F.min(label).cast("int").alias("_label"))


def _with_texts(docs: DataFrame, told: DataFrame, key: str, text: str, few: bool) -> DataFrame:
    side = told.select(F.col(key).alias("_drawn"), "_label")
    return docs.join(F.broadcast(side) if few else side, F.col(key) == F.col("_drawn")).select(
        F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.col("_label").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, where: Column | None = None) -> DataFrame:
    """(key, text, label) of all labelled documents. Null keys and labels other than 0 and 1 are left out, a key with
    several labels gets the smallest, and null texts are empty."""
    told = _labelled(labels, key, label, where)
    return _with_texts(docs, told, key, text, told.count() <= BROADCAST_ROWS)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS,
                    where: Column | None = None) -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled documents, drawn by the hash of the key, otherwise as
    ``labelled_rows``. Only fitting is bounded like this; scores cover every row."""
    told = _labelled(labels, key, label, where)
    drawn = told.withColumn("_draw", F.xxhash64(key)).orderBy("_draw", key).limit(rows)
    return _with_texts(docs, drawn, key, text, True)
