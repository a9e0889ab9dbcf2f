"""Packed products against plain integers, and mined negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import negatives
from riskweave.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])


@pytest.mark.parametrize("low, high", [(-150, 150), (0, 3), (5, 9), (-9, -5), (0, 0), (-(2**20), 2**20), (-(2**63), 2**63 - 1)])
@pytest.mark.parametrize("rows", [1, 7, 300])
def test_packed_products(low, high, rows):
    rng = random.Random(rows)
    draw = lambda n: np.array([[rng.randint(low, high) for _ in range(6)] for _ in range(n)], np.int64)
    vectors, anchors = draw(rows), draw(5)
    packed = negatives.Packed(vectors, max(abs(low), abs(high)))
    want = [[max(-negatives.LARGEST, min(negatives.LARGEST, sum(a * b for a, b in zip(x, y)))) for y in vectors.tolist()] for x in anchors.tolist()]
    assert packed.scores(anchors).tolist() == want
    assert packed.fields >= 2 or high - low > 2**20


def plain(rows, anchors):
    """rows: vec_id -> (label, whole vector)."""
    out = []
    for a in anchors:
        label, v = rows[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items()}
        order = sorted(rows, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and rows[i][0] == label][:5]:
            hard = [i for i in order if rows[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(hard[:5])]
    return out


@pytest.mark.parametrize("block_rows, block_anchors", [(8192, 4096), (37, 2)])
def test_query(spark, tmp_path, monkeypatch, block_rows, block_anchors):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block_anchors)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    data = [(i, [c + rng.gauss(0, 0.5) for c in rng.choice(centres)], rng.randrange(10), "x", "y") for i in range(600)]
    data[300:340] = [(i, data[7][1], rng.randrange(3), "x", "y") for i in range(300, 340)]  # equal vectors tie
    nan, inf = float("nan"), float("inf")
    odd = [(700, None, 1), (800, [nan] * 8, 1), (801, [inf] * 8, 1), (802, [None] * 8, 1), (803, [9.0] * 8, None), (None, [9.0] * 8, 1), (805, [9.0], 1),
           (806, [], 1)]
    spark.createDataFrame([*data, *[(*o, "x", "y") for o in odd], *data[:50]], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("vec_id < 600").collect()}
    rows = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in whole[i]]) for i, _, label, _, _ in data}
    got = sorted(tuple(r) for r in QUERIES["op12_negatives"](spark, str(tmp_path)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == sorted(plain(rows, range(0, 600, 100))) and len(got) > 50


def test_no_rows_no_anchors_no_positives(spark):
    mine = lambda rows: negatives.hard_negatives(
        spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0).collect()
    assert mine([]) == [] and mine([(1, [1.0], 0, None, None)]) == []
    assert mine([(100, [1.0], 0, None, None), (1, [1.0], 1, None, None)]) == []  # no positive
    assert mine([(100, [1.0], 0, None, None), (2, [1.0], 0, None, None), (1, [-1.0], 1, None, None)]) == []  # no negative in range
    rows = mine([(100, [1.0], 0, None, None), (2, [1.0], 0, None, None), (1, [0.9], 1, None, None)])
    assert [tuple(r) for r in rows] == [(100, 2, 1, 1, 65536, 256 * 230)]


def test_huge_components_do_not_overflow(spark):
    rows = [(100, [3e38, 1.0], 0, None, None), (1, [3e38, 2.0], 0, None, None), (2, [2e38, 1.0], 1, None, None)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"), F.col("id") == 100).collect()
    assert [(r.positive_score, r.negative_score) for r in got] == [(negatives.LARGEST, negatives.LARGEST)]
