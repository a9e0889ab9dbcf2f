"""Both sides of every size switch on the same odd rows, and rows without keys."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions import arrays
from riskweave.operators import neighbours, profile, sampling, selection, words
from riskweave.operators import sequences as S


@pytest.mark.parametrize("key_rows", [10**6, 3])
def test_sequences_with_missing_order_values_and_keys(spark, key_rows):
    """The first rows of the key have no order value, so they have no slice either."""
    data = [(i, 1, None if i < 3 else i) for i in range(12)] + [(100 + i, None, i) for i in range(20)]
    df = spark.createDataFrame(data, "id int, k int, o int")
    got = S.sliding_sequences(df, "k", ["o", "id"], {"id": F.col("id")}, 2, key_rows=key_rows, slice_rows=4)
    assert {r["id"]: [s["id"] for s in r["seq"]] for r in got.collect()} == {i: [i - 2, i - 1] for i in range(2, 12)}


@pytest.mark.parametrize("lookup_words", [1000, 1])
def test_encoding_repeated_rows(spark, lookup_words):
    vocabulary = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "word string, word_id int")
    rows = [(1, "a b"), (1, "a b"), (1, "c z"), (2, ""), (2, ""), (None, "b"), (3, None)]
    got = words.encode_tokens(spark.createDataFrame(rows, "k int, t string"), "k", "t", vocabulary, lookup_words=lookup_words)
    assert sorted(((r["k"] or 0), r["ids"]) for r in got.collect()) == [(0, [3]), (1, [2, 3]), (1, [2, 3]), (1, [4, 1]), (2, []), (2, []), (3, [])]


@pytest.mark.parametrize("unroll", [64, 0])
def test_layers_refuse_other_lengths(spark, monkeypatch, unroll):
    monkeypatch.setattr(arrays, "UNROLL", unroll)
    layer = arrays.dense_layer("x", [[1.0], [2.0]], [0.5])
    assert [r[0] for r in spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>").select(layer).collect()] in ([[5.5], None], [[5.5], [None]])
    for x in ([1.0], [1.0, 2.0, 3.0]):
        with pytest.raises(Exception, match="another number of values"):
            spark.createDataFrame([(x,)], "x array<double>").select(layer).collect()


def test_missing_keys_are_no_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [("a", 2)]
    assert {tuple(r) for r in profile.value_counts(df, "k", keep_null=True).collect()} == {("a", 2), (None, 1)}
    assert [tuple(r) for r in profile.user_stats(df, "k", "v").collect()] == [("a", 2.0, 2)]
    assert [tuple(r) for r in profile.segment_risk(df, "k", "v").collect()] == [("a", 2.0, 2)]
    assert sorted(r["user_mean_order"] or 0 for r in profile.attach_group_stats(df, "k", "v").collect()) == [0, 2.0, 2.0]


@pytest.mark.parametrize("task_rows", [10**5, 3])
def test_stratified_split_is_exact_on_ties(spark, task_rows):
    once = spark.createDataFrame([(i, i % 2) for i in range(100)], "k int, y int")
    marks = lambda df: sorted(map(tuple, df.groupBy("y").agg(F.sum("is_test")).collect()), key=repr)
    split = lambda df: sampling.stratified_split(df, "k", "y", 0.2, task_rows=task_rows)
    assert marks(split(once)) == [(0, 10), (1, 10)]
    assert split(once).where("is_test = 1").exceptAll(split(once.repartition(7)).where("is_test = 1")).isEmpty()
    one_key = once.selectExpr("0 AS k", "y", "k AS other")  # rows of one key that differ otherwise
    assert marks(split(one_key)) == [(0, 10), (1, 10)] and split(one_key).count() == 100
    equal = once.selectExpr("CAST(NULL AS INT) AS k", "nullif(y, 1) AS y")  # equal rows, no key, a class without a name
    assert marks(split(equal)) == [(0, 10), (None, 10)] and split(equal).count() == 100
    assert split(once.where("k < 0")).count() == 0


@pytest.mark.parametrize("task_rows", [10**5, 2])
def test_ranks_by_digits(spark, task_rows):
    rng = random.Random(7)
    keys = [rng.choice([5, -(2**63), 2**63 - 1, rng.randrange(-(2**62), 2**62), rng.randrange(1000)]) for _ in range(600)]
    data = [(None if i % 3 else "a", k) for i, k in enumerate(keys)] + [("a", None), ("b", 4)]
    found = selection.select_ranks(spark.createDataFrame(data, "g string, key long"),
                                   lambda n: F.array(F.lit(0), F.lit(1), F.ceil(n / 2), n, n + 1), task_rows)
    got = {(r.g, r["rank"]): (r.n, r.key, r.below, r.equal) for r in found.collect()}
    want = {}
    for g in ("a", None, "b"):
        of = sorted(k for h, k in data if h == g and k is not None)
        for rank in (1, -(-len(of) // 2), len(of)):
            k = of[rank - 1]
            want[g, rank] = (len(of), k, sum(x < k for x in of), of.count(k))
    assert got == want


@pytest.mark.parametrize("max_scans", [4, 0])
def test_text_ids_find_the_same_neighbours(spark, max_scans):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(100, 160)]
    numbers = spark.createDataFrame(rows, "id long, embedding array<double>")
    texts = numbers.withColumn("id", F.concat(F.lit("TXN"), F.col("id").cast("string")))
    find = lambda d: neighbours.nearest(d.withColumnRenamed("id", "query_id"), d, 3, exclude_self=True, max_scans=max_scans)
    want = sorted((f"TXN{r.query_id}", r["rank"], f"TXN{r.neighbour_id}", r.distance) for r in find(numbers).collect())
    assert sorted((r.query_id, r["rank"], r.neighbour_id, r.distance) for r in find(texts).collect()) == want


def test_smote_with_text_keys(spark):
    rows = spark.createDataFrame([(f"TXN{i:04d}", int(i % 5 == 0), float(i), float(i * i % 17)) for i in range(60)], "id string, y int, a double, b double")
    out = neighbours.smote(rows, "id", "y", ["a", "b"])
    assert {tuple(r) for r in out.groupBy("y").count().collect()} == {(0, 48), (1, 48)}
