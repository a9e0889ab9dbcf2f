"""From raw documents to token ids, in five stages.

toxicity -> exact dedup -> near-dedup -> mixing sources -> byte-level BPE. Every stage takes the whole result of
the one before, written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, exact, mixing, simhash, toxicity
from riskweave.llm.common import bounded_batches, text_of
from riskweave.llm.training import labelled_sample
from riskweave.session import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# The classifier of the first stage and the bisection of the fourth have no SQL twin, so the tests check the rows of run().
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not take for toxic; null texts stay."""
    labels = bounded_batches(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    chain = toxicity.fit(labelled_sample(docs, labels, "doc_id", "text", "toxic"))
    return docs.where(chain.probabilities(text_of("text"))["toxic"] < chain.threshold)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of all whose texts are equal but for white space: that with the smallest doc_id."""
    return exact.drop_copies(docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies: fingerprints over three-word shingles, linked at three differing bits
    or fewer. The document with the smallest doc_id stays."""
    bounded_batches(spark)
    return simhash.drop_near_copies(docs, "doc_id", "text", shingle=3, reach=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for; a repeated one is a repeated row. The budget is as many words
    as come in, so large sources give up some documents and small ones repeat theirs, up to four passes."""
    return mixing.mix(docs, "doc_id", "source", "text").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding them gives the text back."""
    bounded_batches(spark)
    rows = docs.select("doc_id", "source", text_of("text").alias("text"))
    rows = rows.withColumn("t", bpe.encode_and_decode("text", VOCABULARY, public_tokenizers.PATTERN))
    return rows.select("doc_id", "source", F.size("t.ids").cast("long").alias("n_tokens"), F.col("t.ids").alias("ids"),
                       (F.col("t.decoded") == F.encode("text", "UTF-8")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of the folder. What stages hand on lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{place}/{number}-{name}")
        docs = spark.read.parquet(path)
    return docs
