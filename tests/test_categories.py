import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from riskweave.operators import categories as C

DATA = [(1, "b", 10, 2.5), (2, "a", None, 0.0), (3, None, 20, None), (4, "b", 10, -1.0), (5, "c", 30, 4.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(DATA, "id int, k string, n int, x double")


def vectors(df, key="id", col="features"):
    return {r[key]: (r[col]["size"], dict(zip(r[col]["indices"], r[col]["values"]))) for r in df.collect()}


def listed(d):
    return {(r["column"], r["value"]): r["slot"] for r in d.collect()}


def test_slots_follow_columns_and_values(table):
    d = C.fit_categories(table, ["k", "n"])
    assert listed(d) == {("k", "a"): 0, ("k", "b"): 1, ("k", "c"): 2, ("n", "10"): 3, ("n", "20"): 4, ("n", "30"): 5}
    got = vectors(C.encode_categories(table, d, ["k", "n"]))
    assert got == {1: (6, {1: 1, 3: 1}), 2: (6, {0: 1}), 3: (6, {4: 1}), 4: (6, {1: 1, 3: 1}), 5: (6, {2: 1, 5: 1})}


def test_first_value_dropped_and_unseen_values_all_zero(table):
    d = C.fit_categories(table.where("id < 5"), ["k", "n"], drop_first=True)
    assert listed(d) == {("k", "b"): 0, ("n", "20"): 1}
    got = vectors(C.encode_categories(table, d, ["k", "n"]))
    assert got == {1: (2, {0: 1}), 2: (2, {}), 3: (2, {1: 1}), 4: (2, {0: 1}), 5: (2, {})}


def test_numeric_columns_in_front(table):
    got = vectors(C.encode_categories(table, C.fit_categories(table, ["k"]), ["k"], numeric=["x"]))
    assert got[1] == (4, {0: 2.5, 2: 1.0}) and got[2] == (4, {1: 1.0}) and got[4] == (4, {0: -1.0, 2: 1.0})
    assert got[3][0] == 4 and list(got[3][1]) == [0] and np.isnan(got[3][1][0])


def test_rare_values_are_shuffled_and_frequent_ones_broadcast(spark, monkeypatch):
    """Every third row holds one value, every fifth none; a line below the limit and one above meet the same slots."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None)
                                  .otherwise((F.col("id") % 700).cast("string")).alias("k"))
    want = None
    for frequent in (1, 50, 10**6):  # no value is frequent, the hot one is, all are
        monkeypatch.setattr(C, "FREQUENT", frequent)
        d = C.fit_categories(df, ["k"])
        assert d.where("frequent").count() == {1: 0, 50: 1}.get(frequent, d.count())
        got = vectors(C.encode_categories(df, d, ["k"]))
        assert len(got) == 3000 and (want is None or got == want)
        want = got
    slots = listed(d)
    assert got[0][1] == {slots["k", "hot"]: 1.0} and got[5][1] == {} and got[7][1] == {slots["k", "7"]: 1.0}


def test_stored_dictionary_grows_without_moving_slots(spark, table, tmp_path):
    C.save_categories(C.fit_categories(table.where("id < 5"), ["k", "n"]), str(tmp_path / "d"))
    old = C.load_categories(spark, str(tmp_path / "d"))
    more = spark.createDataFrame([(6, "aa", 10), (7, "z", None)], "id int, k string, n int")
    grown = C.extend_categories(old, more, ["k", "n"])
    before, after = listed(old), listed(grown)
    assert {p: after[p] for p in before} == before
    assert {p: s for p, s in after.items() if p not in before} == {("k", "aa"): 4, ("k", "z"): 5}
    assert listed(C.extend_categories(grown, more, ["k", "n"])) == after  # nothing new
    counts = {(r["column"], r["value"]): r["n"] for r in C.category_frequencies(more, grown, ["k", "n"]).collect()}
    assert counts[("k", "z")] == 1 and counts[("n", "10")] == 1 and counts[("k", "b")] == 0


def test_empty_table_and_clashing_names(spark, table):
    empty = C.fit_categories(table.where("false"), ["k"])
    assert empty.count() == 0
    odd = table.withColumn("slot", F.lit(7)).withColumn("value", F.lit("v")).withColumn("column", F.lit("c"))
    got = C.encode_categories(odd, C.fit_categories(odd, ["k", "value"]), ["k", "value"])
    assert got.columns == [*odd.columns, "features"] and vectors(got)[1] == (4, {1: 1, 3: 1})
    assert vectors(C.encode_categories(table, empty, ["k"])) == {i: (0, {}) for i in range(1, 6)}


def test_vectors_for_models(spark, table, tmp_path):
    d = C.fit_categories(table, ["k"])
    back = C.as_vectors(C.encode_categories(table.where("id <> 3"), d, ["k"]), str(tmp_path / "v"))
    assert {r["id"]: r["features"] for r in back.collect()}[5] == SparseVector(3, [2], [1.0])


def test_a_million_categories(spark, tmp_path):
    """A label that follows from the category is learnt from vectors a million wide; unseen values are all zero."""
    df = spark.range(1_200_000, numPartitions=8).select(
        "id", F.when(F.col("id") < 200_000, F.concat(F.lit("h"), F.col("id") % 4)).otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2).cast("double").alias("label"))
    d = C.fit_categories(df, ["k"])
    save = str(tmp_path / "d")
    C.save_categories(d, save)
    d = C.load_categories(spark, save)
    assert d.agg(F.count("*"), F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()[:] == (1_000_004, 0, 1_000_003, 1_000_004)
    rows = df.where("id < 4000").unionByName(spark.createDataFrame([(-1, "never seen", 0.0)], df.schema))
    ready = C.as_vectors(C.encode_categories(rows, d, ["k"]), str(tmp_path / "v"))
    vectors = {r["id"]: r["features"] for r in ready.select("id", "features").collect()}
    assert vectors[-1] == SparseVector(1_000_004, [], []) and vectors[5].size == 1_000_004 and vectors[5].numNonzeros() == 1
    model = LogisticRegression(maxIter=5, regParam=0.01).fit(ready.where("id >= 0"))
    wrong = model.transform(ready.where("id >= 0")).where("prediction <> label").count()
    assert model.numFeatures == 1_000_004 and wrong == 0
