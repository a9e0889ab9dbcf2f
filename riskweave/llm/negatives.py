"""Hard-negative mining with Kronecker-packed inner products.

Vectors are rounded to integers. The components of several candidates, made non-negative by a bias, lie in separate
bit fields of one wide integer; multiplying that integer by one component of an anchor multiplies all of them at once,
and the sum over the dimensions holds every candidate's product in its field. Fields are as wide as the largest sum
needs, so none runs into the next, and taking the bias off gives exact scores. The wide integer is one of 53 bits, which
a double holds exactly, so one matrix product does the multiplications of a block; where fewer than two fields fit into
53 bits, it is a Python integer of any width.

Anchors are a set of queries against all rows. Both sides are dealt into blocks of bounded size by hash, and every block
of anchors meets every block of rows in a task of its own, so it matters neither how many rows share a label or a
vector, nor how many anchors there are. The first round finds the positives, of which a task passes on the best few
of each anchor; the second finds the negatives, whose range of scores then is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

SCALE = 256
WORD = 53  # bits of an integer that a double holds exactly
LARGEST = (2**63 - 1) // 100  # scores beyond are taken as this, so that 100 times a score is a long
BLOCK_ROWS = 8192  # candidates of a task
BLOCK_ANCHORS = 4096
STEP = 256  # anchors whose scores are held at once
POSITIVES = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


# ---------------------------------------------------------------- packed products

class Packed:
    """Candidates in bit fields of wide integers, ready to be multiplied by anchors whose components do not exceed
    ``largest`` in size."""

    def __init__(self, vectors: np.ndarray, largest: int):
        self.rows, dims = vectors.shape
        self.bias = -int(vectors.min(initial=0))
        self.field = (dims * max(1, largest) * (int(vectors.max(initial=0)) + self.bias)).bit_length() + 1  # one bit for the sign
        self.fields = WORD // self.field
        if self.fields < 2:  # one Python integer per dimension holds all candidates
            self.field = -(-self.field // 8) * 8
            self.words = [self._pack(int(x) + self.bias for x in column) for column in vectors.T]
            return
        self.words = np.zeros((dims, -(-self.rows // self.fields)))
        for j in range(self.fields):
            part = vectors[j :: self.fields].T + float(self.bias)
            self.words[:, : part.shape[1]] += part * 2.0 ** (self.field * j)

    def _pack(self, numbers: Iterable[int]) -> int:
        return int.from_bytes(b"".join(x.to_bytes(self.field // 8, "little") for x in numbers), "little")

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows) and candidates (columns), exact but for the limit LARGEST."""
        low = 1 << (self.field - 1)  # lifts a field's sum above 0, so that no field borrows from the next
        if self.fields < 2:
            return np.array([self._wide(anchor, low) for anchor in anchors.tolist()], np.int64).reshape(-1, self.rows)
        word = (anchors.astype(np.float64) @ self.words).astype(np.int64)
        word += sum(low << (self.field * j) for j in range(self.fields))
        off = low + self.bias * anchors.sum(axis=1)
        out = np.empty((len(anchors), self.words.shape[1] * self.fields), np.int64)
        for j in range(self.fields):
            out[:, j :: self.fields] = (word >> (self.field * j) & ((1 << self.field) - 1)) - off[:, None]
        return out[:, : self.rows]

    def _wide(self, anchor: Sequence[int], low: int) -> list[int]:
        size, off = self.field // 8, low + self.bias * sum(anchor)
        word = self._pack([low] * self.rows) + sum(a * w for a, w in zip(anchor, self.words))
        sums = word.to_bytes(size * self.rows, "little")
        return [max(-LARGEST, min(LARGEST, int.from_bytes(sums[i : i + size], "little") - off)) for i in range(0, len(sums), size)]


# ---------------------------------------------------------------- rows

def whole_vectors(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): vectors with every component x as floor(256 x), a long (beyond its range the nearest one).

    Rows with a null key, label or vector, an empty vector, or a null or non-finite component are left out, and so are
    vectors whose length differs from the commonest one. Of rows that repeat a key the one with the smallest label, then
    vector, takes part.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    rows = df.where(F.coalesce(fine, F.lit(False)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))
    rows = rows.where("label IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def first(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among the given places, ties to the smaller id."""
    if len(among) > k:
        value = scores[among]
        among = among[value >= np.partition(value, len(value) - k)[len(value) - k]]
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, compare: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``compare(anchor, scores, ids, labels)`` for every anchor and every block of rows; its tuples are the result."""
    r_blocks, a_blocks = -(-n_rows // BLOCK_ROWS), -(-n_anchors // BLOCK_ANCHORS)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(block(r_blocks).alias("r_block"), every(a_blocks).alias("a_block"), "id", "label", "v")
    right = anchors.select(every(r_blocks).alias("r_block"), block(a_blocks).alias("a_block"), *anchors.columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def task(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(anchors):
            queries = np.stack(anchors["v"].to_numpy())
            packed = Packed(np.stack(rows["v"].to_numpy()), int(max(queries.max(), -int(queries.min()))))
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            told = list(anchors.drop(columns=["r_block", "a_block", "v"]).itertuples(index=False))
            for i in range(0, len(told), STEP):
                for anchor, scores in zip(told[i : i + STEP], packed.scores(queries[i : i + STEP])):
                    found += compare(anchor, scores, ids, labels)
        return pd.DataFrame(found, columns=names).astype("int64")

    keys = ["r_block", "a_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, schema)


def ranked(df: DataFrame, keys: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that ``is_anchor`` (over
    ``id``) marks and each of its positives.

    Scores are integer inner products with the anchor; higher ones come first, ties by smaller key. Positives are the
    first ``positives`` other rows of the anchor's label; negatives of one are the first ``negatives`` rows of other labels
    whose score lies within ``low`` and ``high`` percent of the positive's. Where there are fewer, all are returned: an
    anchor without positives and a positive without negatives get no row, an empty table none at all. Rows that take no
    part: see ``whole_vectors``. Scores beyond LARGEST in size count as LARGEST. Other columns of ``df`` do not matter.
    """
    rows = materialize(whole_vectors(df, key, vector, label))
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def alike(anchor, scores, ids, labels):
        for j in first(scores, ids, np.flatnonzero((labels == anchor.label) & (ids != anchor.id)), positives):
            yield anchor.id, ids[j], scores[j]

    near = ranked(met(rows, anchors, n_rows, n_anchors, alike, POSITIVES), ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("positive_score").alias("positive_scores"))
    asked = materialize(anchors.join(near, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positive_ids", "positive_scores"))

    def unlike(anchor, scores, ids, labels):
        other = np.flatnonzero(labels != anchor.label)
        hundredfold = 100 * scores[other]
        for positive, score in zip(anchor.positive_ids.tolist(), anchor.positive_scores.tolist()):
            within = other[(hundredfold >= low * score) & (hundredfold <= high * score)]
            for j in first(scores, ids, within, negatives):
                yield anchor.id, positive, score, ids[j], scores[j]

    hard = met(rows, asked, n_rows, n_anchors, unlike, NEGATIVES)
    return ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
