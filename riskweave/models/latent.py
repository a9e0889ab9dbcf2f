"""Text embeddings learnt from a corpus: the leading right singular vectors of its weighted word counts.

Documents are rows, words columns; a weight is (1 + ln tf) * idf, and rows have length 1. The singular vectors come from subspace
iteration with a random start (Halko, Martinsson and Tropp, 2011). The matrix stays in the tasks as blocks of sparse rows.
Each pass sends one words x dimensions matrix out, multiplies every block by it and by its own transpose, and adds the products up
per block of words, as they come. The number of words is a parameter, so that matrix has a known size on the driver and in a task,
whatever the number of documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize

MATRIX_BYTES = 256 << 20  # of words x dimensions
PRODUCT_CELLS = 4_000_000  # of the products formed at a time
WORD_BLOCK = 1024
LINES = "slot int, sums array<double>"


def words_of(text: Column | str) -> Column:
    return F.coalesce(X.tokenize(X.clean_text(text)), F.array().cast("array<string>"))


def _weighted(column: pa.Array, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and weight of the listed words; rows in order, each of length 1 unless it has no listed word."""
    found = pc.index_in(column.flatten(), value_set=vocabulary)
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    known = found.is_valid().to_numpy(zero_copy_only=False)
    pair, tf = np.unique(row[known] * np.int64(len(vocabulary)) + found.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
    row, slot = pair // len(vocabulary), pair % len(vocabulary)
    weight = (1 + np.log(tf)) * idf[slot]
    length = np.sqrt(np.bincount(row, weight ** 2, len(column)))
    return row, slot, weight / np.where(length > 0, length, 1)[row]


def _times(row: np.ndarray, slot: np.ndarray, weight: np.ndarray, matrix: np.ndarray, rows: int) -> np.ndarray:
    """The block of sparse rows times the matrix."""
    out = np.zeros((rows, matrix.shape[1]))
    step = max(1, PRODUCT_CELLS // matrix.shape[1])
    for lo in range(0, len(row), step):
        r = row[lo:lo + step]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[starts]] += np.add.reduceat(weight[lo:lo + step, None] * matrix[slot[lo:lo + step]], starts)
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    """A list per row."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).ravel()))


def _lines(total: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(slots), WORD_BLOCK):
        some = slots[lo:lo + WORD_BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _lists(total[some])], names=["slot", "sums"])


def _multiply(shared):
    """Every task's share of (transposed matrix x matrix x V), a line per word it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total, met = np.zeros_like(v), np.zeros(len(v), bool)
        for batch in batches:
            slots = batch.column(0)
            sizes = pc.list_value_length(slots).to_numpy(zero_copy_only=False)
            row, slot = np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy(zero_copy_only=False)
            weight = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            y = _times(row, slot, weight, v, len(sizes))
            order = np.argsort(slot, kind="stable")  # transposed: words become the rows
            step = max(1, PRODUCT_CELLS // v.shape[1])
            for lo in range(0, len(order), step):
                part = order[lo:lo + step]
                s = slot[part]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                total[s[starts]] += np.add.reduceat(weight[part, None] * y[row[part]], starts)
            met[slot] = True
        yield from _lines(total, np.flatnonzero(met))

    return run


def _add_up(words: int, width: int):
    """Lines of the same word become one, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            sums = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(slot[order]) != 0])
            slot, sums = slot[order][starts], np.add.reduceat(sums[order], starts)
            for b in np.unique(slot // WORD_BLOCK).tolist():
                lo, hi = np.searchsorted(slot, [b * WORD_BLOCK, (b + 1) * WORD_BLOCK])
                blocks.setdefault(b, np.zeros((WORD_BLOCK, width)))[slot[lo:hi] - b * WORD_BLOCK] += sums[lo:hi]
        for b, total in sorted(blocks.items()):
            slots = np.arange(b * WORD_BLOCK, min((b + 1) * WORD_BLOCK, words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int32()), _lists(total[:len(slots)])], names=["slot", "sums"])

    return run


def _gram_times(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(v)
    lines = rows.mapInArrow(_multiply(shared), LINES)
    whole = lines.repartition(F.floor(F.col("slot") / WORD_BLOCK)).mapInArrow(_add_up(*v.shape), LINES).toArrow()
    out = np.zeros_like(v)
    if whole.num_rows:
        out[whole.column("slot").to_numpy()] = whole.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, v.shape[1])
    shared.destroy()
    return out


@dataclass
class Latent:
    """Words, their weights, and a vector per word; ``singular`` are the singular values of the training matrix."""

    words: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray

    def embed(self, text: Column | str) -> Column:
        """Unit vector of a text; all zeros without any listed word, also for NULL."""
        vocabulary, idf, vectors = pa.array(self.words, pa.string()), self.idf, self.vectors

        @F.arrow_udf("array<double>")
        def unit(column: pa.Array) -> pa.Array:
            y = _times(*_weighted(column, vocabulary, idf), vectors, len(column))
            length = np.sqrt(np.einsum("ij,ij->i", y, y))
            return _lists(y / np.where(length > 1e-12, length, np.inf)[:, None])

        return unit(words_of(text))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w, float(f), v.tolist()) for i, (w, f, v) in enumerate(zip(self.words, self.idf, self.vectors))]
        spark.createDataFrame(rows, "slot int, word string, idf double, vector array<double>").write.parquet(f"{path}/words")
        spark.createDataFrame([(self.singular.tolist(),)], "singular array<double>").write.parquet(f"{path}/singular")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Latent:
        t = spark.read.parquet(f"{path}/words").orderBy("slot").toArrow()
        return Latent(t.column("word").to_pylist(), t.column("idf").to_numpy(), np.array(t.column("vector").to_pylist()),
                      np.array(spark.read.parquet(f"{path}/singular").first()["singular"]))


def fit_latent(df: DataFrame, text: str, dim: int = 64, max_words: int = 50_000, passes: int = 4, extra: int = 16, seed: int = 42) -> Latent:
    """Vectors of the ``max_words`` words that most documents hold (ties by alphabet), from all documents.

    ``passes`` products with the whole matrix, on ``dim + extra`` directions of which the first ``dim`` are kept; fewer, if
    there are not as many words. Empty and NULL texts count for nothing. No word at all: ValueError.
    """
    if passes < 1:
        raise ValueError("at least one pass is needed")
    if 8 * max_words * (dim + extra) > MATRIX_BYTES:
        raise ValueError("words x dimensions is larger than MATRIX_BYTES")
    tokens = df.select(words_of(text).alias("w")).where(F.size("w") > 0)
    held = tokens.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    listed = held.orderBy(F.desc("n"), F.asc("word")).limit(max_words).toArrow()
    if not listed.num_rows:
        raise ValueError("the corpus has no words")
    n = tokens.count()
    vocabulary = listed.column("word").combine_chunks().cast(pa.string())
    idf = np.log((n + 1) / (listed.column("n").to_numpy() + 1)) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot, weight = _weighted(batch.column(0), vocabulary, idf)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(weight))], names=["slots", "weights"])

    rows = materialize(tokens.mapInArrow(encode, "slots array<int>, weights array<double>").where(F.size("slots") > 0))
    width = min(dim + extra, len(vocabulary))
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(vocabulary), width)))[0]
    for step in range(passes):
        v = v if not step else np.linalg.qr(z)[0]
        z = _gram_times(rows, v)
    # The last product shows the matrix from the directions that went into it; their best mixture needs no further pass.
    gram = v.T @ z
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-values)[:dim]
    vectors = v @ turn[:, best]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Latent(vocabulary.to_pylist(), idf, vectors * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(values[best], 0)))


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
