import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import vector_index as V


def brute(queries, stored, k, skip_self=False):
    out = []
    for qi, q in queries:
        ranked = sorted((float(np.sum((np.array(q) - np.array(c)) ** 2)), ci) for ci, c in stored if not (skip_self and ci == qi))
        out += [(qi, r + 1, ci) for r, (_, ci) in enumerate(ranked[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["neighbour_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    """Twelve clusters, ties on a coarse grid, and a third of the rows on one spot."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-40, 40, (12, 4)) * 4.0
    data = [(i, [float(v) for v in middles[i % 12] + rng.integers(0, 4, 4)]) for i in range(400)]
    data += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400, 600)]
    return spark.createDataFrame(data, "id long, embedding array<double>").repartition(5), data


@pytest.fixture(scope="module")
def index(points, tmp_path_factory):
    df, _ = points
    path = str(tmp_path_factory.mktemp("index") / "i")
    V.build_index(df.where("id % 3 <> 0"), path, cells=16)
    V.append_index(df.where("id % 3 = 0 AND id < 300"), path)
    V.append_index(df.where("id % 3 = 0 AND id >= 300"), path)
    return path


@pytest.mark.parametrize("k, skip_self, block_rows", [(1, False, 20_000), (5, True, 20_000), (7, False, 15), (700, True, 50)])
def test_exact_after_appends(points, index, k, skip_self, block_rows):
    df, data = points
    asked = [d for d in data if d[0] % 17 == 0]
    got = V.search_index(df.where("id % 17 = 0").withColumnRenamed("id", "query_id"), index, k, exclude_self=skip_self, block_rows=block_rows)
    assert found(got) == brute(asked, data, k, skip_self)


def test_reads_only_the_cells_it_needs(spark, points, index):
    df, data = points
    files = len(V.read_cells(spark, index, list(range(16))).inputFiles())
    asked = [(1, [float(v) for v in data[5][1]])]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    second = V.search_index(q, index, 2)
    assert found(second) == brute(asked, data, 2)
    # What is left in the plan is the second visit; the first one read the cells nearest to the query.
    assert len(second.inputFiles()) < files / 2
    assert all("/vectors/batch=" in f for f in second.inputFiles())
    one = V.read_cells(spark, index, [0])
    assert 0 < len(one.inputFiles()) < files and {r[0] for r in one.select("cell").distinct().collect()} == {0}


def test_layout_matches_what_is_stored(spark, points, index):
    assert V.cell_layout(spark, index).agg(F.sum("n"), F.count_distinct("batch")).first()[:] == (600, 3)
    assert V.read_cells(spark, index, list(range(16))).select("id").distinct().count() == 600


def test_unfinished_batch_does_not_count(spark, points, index):
    """Vectors whose line was never written are not read."""
    df, data = points
    spark.createDataFrame([(9999, data[0][1], 0.0, 0)], V.CELL_ROWS + ", cell int").write.partitionBy("cell").parquet(f"{index}/vectors/batch=lost")
    q = spark.createDataFrame([(1, data[0][1])], "query_id long, embedding array<double>")
    assert found(V.search_index(q, index, 3)) == brute([(1, data[0][1])], data, 3)


def test_far_away_random_and_many_dimensions(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=24).tolist()) for i in range(300)]
    asked = [(i, (rng.normal(size=24) * scale).tolist()) for i, scale in enumerate([1, 1, 1, 100, 1e4, 0])]
    V.build_index(spark.createDataFrame(data, "id long, embedding array<double>"), str(tmp_path / "i"))
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    assert found(V.search_index(q, str(tmp_path / "i"), 4)) == brute(asked, data, 4)


def test_odd_rows(spark, tmp_path):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, []), (5, [2.0, 2.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    path = str(tmp_path / "i")
    V.build_index(df, path, cells=5)
    q = df.withColumnRenamed("id", "query_id")
    assert found(V.search_index(q, path, 3)) == [(1, 1, 1), (1, 2, 5), (5, 1, 5), (5, 2, 1)]
    assert V.search_index(q.where("query_id = 2"), path, 3).count() == 0
    V.append_index(df.where("id = 2"), path)  # nothing usable
    for bad in ("id = 9", "false"):
        with pytest.raises(ValueError):
            V.build_index(df.where(bad), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        V.append_index(spark.createDataFrame([(7, [1.0])], "id int, embedding array<double>"), path)
    with pytest.raises(ValueError):
        V.build_index(spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>"), str(tmp_path / "text"))


def test_all_vectors_alike(spark, tmp_path):
    df = spark.range(50).select("id", F.array(F.lit(1.5), F.lit(2.5)).alias("embedding"))
    V.build_index(df, str(tmp_path / "i"))
    got = V.search_index(df.where("id = 3").withColumnRenamed("id", "query_id"), str(tmp_path / "i"), 4, exclude_self=True)
    assert found(got) == [(3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4)]
