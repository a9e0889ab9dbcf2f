import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import prepare, sampling


def test_scaler_uses_population_deviation_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    got = prepare.standard_scale(df, ["x", "c"]).toPandas()
    x = np.array([1.0, 2.0, 4.0])
    assert got["x"].to_numpy() == pytest.approx((x - x.mean()) / x.std())
    assert list(got["c"]) == [0.0, 0.0, 0.0]


def test_train_statistics_apply_elsewhere(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    other = spark.createDataFrame([(5.0,), (None,)], "x double")
    got = prepare.apply_scaler(other, prepare.scaler_stats(train, ["x"]), ["x"]).collect()
    assert [r["x"] for r in got] == [4.0, None]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (None, None), (4.0, "b"), (9.0, "a")], "x double, s string")
    got = prepare.impute(df, ["x"], ["s"]).toPandas()
    assert sorted(got["x"]) == [1.0, 4.0, 4.0, 4.0, 9.0]
    assert sorted(got["s"]) == ["a", "a", "a", "b", "b"]  # tie goes to the smaller value


def test_winsorize(spark):
    values = [float(v) for v in range(101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r["x"] for r in prepare.winsorize(df, ["x"], 0.9).collect()]
    assert max(v for v in got if v is not None) == 90.0 and None in got and sum(v == 90.0 for v in got) == 11


def test_encodings(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "i int, v string")
    fit = df.where("v <> 'c'")
    assert rows(prepare.one_hot_ignore(df, "v", fit_on=fit).drop("v")) == [(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 0, 0)]
    assert prepare.dummies_drop_first(df, ["v"]).columns == ["i", "v_b", "v_c"]
    assert rows(prepare.label_encode(df, "v", "code").select("i", "code")) == [(1, 1), (2, 0), (3, 2), (4, None)]
    assert rows(prepare.category_codes(df, "v", "code").select("i", "code")) == [(1, 1), (2, 0), (3, 2), (4, -1)]


def test_unseen_label_fails(spark):
    from riskweave.operators.ordering import dense_codes

    df = spark.createDataFrame([("a",), ("b",)], "v string")
    codes = dense_codes(df, "v")
    with pytest.raises(Exception, match="unseen category"):
        prepare.label_encode(spark.createDataFrame([("z",)], "v string"), "v", "code", codes).collect()


def test_categories_are_never_cut(spark):
    with pytest.raises(ValueError):
        prepare.categories(spark.range(11), "id", limit=10)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    got = {r["y"]: r["weight"] for r in prepare.class_weights(df, "y").collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    assert prepare.attach_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(8.0)
    assert prepare.pos_weight(df, "y").first()["pos_weight"] == 3.0
    assert prepare.pos_weight(df.where("y = 0"), "y").first()["pos_weight"] is None


def test_order_features_tolerate_missing_columns(spark):
    bare = spark.createDataFrame([(1, 5.0)], "order_id int, amount double")
    got = prepare.order_fraud_features(bare).first()
    assert (got["high_device_change"], got["high_velocity"]) == (0, 0)
    full = spark.createDataFrame(
        [(1, 7, "2024-01-06 10:00:00", 10.0, 3, 3, 0, "east", "card"), (2, 7, "2024-01-08 23:00:00", 30.0, 1, 0, 1, "west", "cash")],
        "order_id int, user_id int, order_date string, order_amount double, device_change_count int, recent_orders_1day int, "
        "recent_orders_1hr int, billing_region string, payment_type string")
    got = {r["order_id"]: r for r in prepare.order_fraud_features(full).collect()}
    assert got[1]["order_value_deviation"] == pytest.approx(0.5, abs=1e-6)
    assert (got[1]["order_hour"], got[1]["order_weekday"], got[1]["high_device_change"], got[1]["high_velocity"]) == (10, 5, 1, 1)
    assert (got[2]["billing_region_west"], got[2]["payment_type_cash"], got[2]["user_device_changes"]) == (1, 1, 3)


# ---------------------------------------------------------------- splits

@pytest.fixture(scope="module")
def labelled(spark):
    pdf = pd.DataFrame({"id": range(1000), "y": [0] * 700 + [1] * 299 + [2], "g": [i // 10 for i in range(1000)]})
    return spark.createDataFrame(pdf)


def test_stratified_counts_are_exact(labelled):
    got = sampling.stratified_split(labelled, "id", "y", 0.2).groupBy("y").agg(F.sum("is_test").alias("n"), F.count("*").alias("all"))
    assert {r["y"]: (r["n"], r["all"]) for r in got.collect()} == {0: (140, 700), 1: (60, 299), 2: (0, 1)}


def test_stratified_does_not_depend_on_layout(labelled, rows):
    a = sampling.stratified_split(labelled.repartition(1), "id", "y", 0.25).select("id", "is_test")
    b = sampling.stratified_split(labelled.repartition(8), "id", "y", 0.25).select("id", "is_test")
    assert rows(a) == rows(b)


def test_groups_stay_together(labelled):
    parts = sampling.group_split(labelled, "g").groupBy("g").agg(F.countDistinct("part").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1
    shares = {r["part"]: r["n"] for r in sampling.group_split(labelled.sparkSession.range(20_000), "id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert shares["test"] / 20_000 == pytest.approx(0.2, abs=0.02) and shares["val"] / 20_000 == pytest.approx(0.1, abs=0.02)


def test_folds_and_tails(labelled):
    folds = sampling.kfold(labelled, "id", 3).groupBy("fold").count().collect()
    assert len(folds) == 3 and min(r["count"] for r in folds) > 250
    assert sampling.random_split(labelled, "id", 0.2).agg(F.avg("is_test")).first()[0] == pytest.approx(0.2, abs=0.05)
    assert sampling.validation_tail(labelled, "id", 0.1).agg(F.avg("is_val")).first()[0] == pytest.approx(0.1, abs=0.04)
