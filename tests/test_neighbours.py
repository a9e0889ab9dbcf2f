import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators.neighbours import nearest, smote


def brute(queries, corpus, k, skip_self):
    out = []
    for qi, q in queries:
        ranked = sorted((float(np.sum((np.array(q) - np.array(c)) ** 2)), ci) for ci, c in corpus if not (skip_self and ci == qi))
        out += [(qi, r + 1, ci) for r, (_, ci) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(v) for v in rng.integers(0, 6, 3)]) for i in range(240)]  # a coarse grid: many ties
    data += [(i, [2.0, 2.0, 2.0]) for i in range(240, 360)]  # a third are copies
    return spark.createDataFrame(data, "id long, embedding array<double>").repartition(5), data


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("limits", [(1 << 25, 4), (2000, 100), (100, 1)])
def test_exact_with_ties_and_copies(points, limits, skip_self):
    df, data = points
    got = nearest(df.withColumnRenamed("id", "query_id"), df, 4, exclude_self=skip_self, block_bytes=limits[0], max_scans=limits[1])
    assert sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in got.collect()) == brute(data, data, 4, skip_self)


def test_crowded_cells_are_cut_into_blocks(points):
    from riskweave.operators import neighbours as N

    df, data = points
    vectors = df.select("id", F.col("embedding").alias("v"))
    hits = N._ranked(N._routed(vectors, vectors, 3, pivots=4, block_rows=10), "q", 3)
    assert sorted((r["q"], r["rank"], r["neighbour_id"]) for r in hits.collect()) == brute(data, data, 3, False)


def test_small_corpus_and_no_queries(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, embedding array<double>")
    q = df.withColumnRenamed("id", "query_id")
    assert nearest(q, df, 5).count() == 4
    assert nearest(q.where("query_id > 9"), df, 5).count() == 0


def test_smote_evens_the_classes_between_neighbours(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(60), "y": [1] * 12 + [0] * 48, "a": rng.normal(size=60), "b": rng.normal(size=60)})
    df = spark.createDataFrame(pdf)
    out = smote(df, "id", "y", ["a", "b"], minority=1, k=3)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 48, 1: 48}
    few = pdf[pdf.y == 1][["a", "b"]]
    made = out.where("synthetic = 1").toPandas()
    assert made["a"].between(few["a"].min(), few["a"].max()).all() and made["id"].isna().all()
    again = smote(df.repartition(7), "id", "y", ["a", "b"], minority=1, k=3).where("synthetic = 1").toPandas()
    assert sorted(made["a"]) == pytest.approx(sorted(again["a"]))


def test_smote_limits(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0), (3, 0, 2.0), (4, 0, 3.0)], "id int, y int, a double")
    with pytest.raises(ValueError):
        smote(df, "id", "y", ["a"])
    even = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0)], "id int, y int, a double")
    assert smote(even, "id", "y", ["a"]).count() == 2
    two = spark.createDataFrame([(i, int(i < 2), float(i)) for i in range(8)], "id int, y int, a double")
    assert smote(two, "id", "y", ["a"]).where("y = 1").count() == 6  # one other minority row is enough
