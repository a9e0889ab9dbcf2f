"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of every partition, added up, finds the digests that may be frequent: with ``counters`` counters,
every digest of at least 1.5 / counters of the rows. There are at most twice as many as counters, whatever the input, so
they can be counted exactly (the verification) and their winners broadcast: copies of a frequent text are settled where
they lie. All other digests are rare enough to be shuffled in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from .common import one_of_each, text_of

COUNTERS = 1000


def normal_text(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def misra_gries(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """(key, n) with lower bounds of the keys' counts; each is short by at most rows / (counters + 1).

    Summaries of partitions are bounded and add up to one of the whole. Null keys are not counted.
    """

    def summarise(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch.iloc[:, 0].value_counts(), fill_value=0)
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        if len(held):
            yield pd.DataFrame({key: held.index, "n": held.to_numpy("int64")})

    schema = T.StructType([df.schema[key], T.StructField("n", T.LongType())])
    return df.select(key).mapInPandas(summarise, schema).groupBy(key).agg(F.sum("n").alias("n"))


def copies(df: DataFrame, key: str, text: str, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised forms are. Of equal texts the row with the smallest key is kept; null keys come
    last, and of rows that tie (repeated rows) exactly one is kept. Null texts count as empty, texts of any length are
    read whole, an empty table gives no rows. Other columns of ``df`` do not matter.
    """
    rows = materialize(df.select(F.col(key).alias("_key"), F.sha2(normal_text(text), 256).alias("_digest"),
                                 F.monotonically_increasing_id().alias("_row")))
    n_rows = rows.count()
    first = F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_row")
    suspects = [r["_digest"] for r in misra_gries(rows, "_digest", counters).where(
        F.col("n") >= max(2, n_rows // (2 * counters))).select("_digest").collect()]
    hot = rows.sparkSession.createDataFrame([(d,) for d in suspects], "_digest string")
    winners = rows.join(F.broadcast(hot), "_digest").groupBy("_digest").agg(F.count("*").alias("_n"), F.min(first).alias("_first"))
    verified = rows.sparkSession.createDataFrame(winners.collect(), winners.schema)
    marked = rows.join(F.broadcast(verified), "_digest", "left")
    same = Window.partitionBy("_digest")
    rare = marked.where("_n IS NULL").withColumns({"_n": F.count("*").over(same), "_first": F.min(first).over(same)})
    return marked.where("_n IS NOT NULL").unionByName(rare).select(
        F.col("_key").alias(key), F.col("_first._key").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_first._row")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_copies(df: DataFrame, key: str, text: str, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that ``copies`` keeps, with all their columns, whatever they are called."""
    found = materialize(copies(df, key, text, counters).select(F.col(key).alias("_key"), F.col("text_sha256").alias("_digest"), "kept"))
    kept = found.where("kept").select(F.col("_key").alias("_kept_key"), F.col("_digest").alias("_kept_digest"))
    repeated = not found.groupBy("_key", "_digest").count().where("count > 1").isEmpty()
    marked = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.sha2(normal_text(text), 256).alias("_digest"))
    left = marked.join(kept, (F.col("_digest") == F.col("_kept_digest")) & F.col("_key").eqNullSafe(F.col("_kept_key")), "left_semi")
    # Only rows that repeat both key and text can still meet here.
    return one_of_each(left, ["_digest", "_key"], repeated).select("_row.*")
