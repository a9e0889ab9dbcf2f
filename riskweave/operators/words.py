"""Vocabulary, token ids and corpus assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MAX_WORDS = 5000  # ids at or above this count as unknown
OOV_ID = 1


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Occurrences per word over the whole texts, combined map-side. The empty strings at the ends
    of a split are dropped after the rows fan out, which is cheaper than filtering every array."""
    pieces = F.split(X.clean_text(text), f"{X.BLANK}+")
    return (
        df.select(F.explode(pieces).alias("word")).where("word <> ''")
        .groupBy("word").agg(F.count("*").alias("n"))
    )


def fit_vocabulary(df: DataFrame, text: str, max_words: int = MAX_WORDS) -> DataFrame:
    """(word, n, word_id) for the words that get an id below ``max_words``: 1 is the unknown word,
    the most frequent word is 2, ties go by the alphabet. At most ``max_words - 2`` rows by
    definition, so numbering them in one window is bounded."""
    top = word_counts(df, text).orderBy(F.desc("n"), F.asc("word")).limit(max_words - 2)
    w = Window.orderBy(F.desc("n"), F.asc("word"))
    return top.select("word", "n", (F.row_number().over(w) + 1).cast("int").alias("word_id"))


LOOKUP_WORDS = 200_000


def encode_tokens(df: DataFrame, key: str, text: str, vocabulary: DataFrame, length: int | None = None,
                  lookup_words: int = LOOKUP_WORDS) -> DataFrame:
    """(key, ids): word ids in text order, unknown words as 1.

    ``length`` asks for fixed-length rows: as later words cannot reach the result, they are dropped
    before the lookup, and short texts are filled with zeros.

    A vocabulary of at most ``lookup_words`` words is sent to the tasks and looked up there, so no
    token is ever shuffled. A larger one is joined, which needs the words of a text put together again.
    """
    words = F.coalesce(X.tokenize(X.clean_text(text)), F.array().cast("array<string>"))
    if length is not None:
        words = F.slice(words, 1, length)
    known = vocabulary.select("word", "word_id").limit(lookup_words + 1).toArrow()
    if known.num_rows <= lookup_words:
        ids = df.select(key, _lookup(df.sparkSession, known)(words).alias("ids"))
    else:
        ids = _join_ids(df, key, words, vocabulary)
    return ids.withColumn("ids", X.pad_truncate("ids", length)) if length is not None else ids


def _lookup(spark, known: pa.Table):
    shared = spark.sparkContext.broadcast((
        known.column("word").combine_chunks(), known.column("word_id").combine_chunks().cast(pa.int32())))

    @F.arrow_udf("array<int>")
    def ids_of(words: pa.Array) -> pa.Array:
        vocabulary, ids = shared.value
        at = pc.index_in(words.flatten(), value_set=vocabulary)
        found = pc.fill_null(ids.take(at), OOV_ID)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, found)

    return ids_of


def _join_ids(df: DataFrame, key: str, words: Column, vocabulary: DataFrame) -> DataFrame:
    """Rows that repeat both key and words have equal ids: they are put together once and then repeated."""
    rows = df.select(F.col(key), words.alias("_words")).withColumn("_text", F.sha2(F.array_join("_words", " "), 256))
    tokens = rows.select(key, "_text", F.posexplode_outer("_words").alias("pos", "word"))
    return (
        tokens.join(vocabulary.select("word", "word_id"), "word", "left")
        .select(key, "_text", F.coalesce("pos", F.lit(0)).alias("pos"), F.when(F.col("pos").isNotNull(), F.struct(
            "pos", F.coalesce("word_id", F.lit(OOV_ID)).alias("id"))).alias("e"))
        .groupBy(key, "_text").agg(F.sort_array(F.collect_set("e")).alias("e"), F.count_if(F.col("pos") == 0).alias("_n"))
        .select(key, F.transform("e", lambda s: s["id"]).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
        .drop("_copy")
    )


def load_corpus(df: DataFrame, key: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """One stripped text per document from its pages in order. The result is one value per
    document, so a document's pages meet in one place by definition."""
    return (
        df.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))
        .select(key, X.strip(F.array_join(F.transform("_p", lambda s: s["t"]), sep)).alias("text"))
    )


def count_profile(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, X.count_paragraphs(text).alias("n_paragraphs"), X.count_words(text).alias("n_words"))


def split_paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-blank paragraph, numbered from 0."""
    return df.select(key, F.posexplode(X.paragraphs(text)).alias("paragraph_no", "paragraph"))
