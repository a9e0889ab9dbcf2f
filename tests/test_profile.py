import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import ordering, profile, sketches


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, 30.0, 3000), 3)
    x[::3] = 7.0  # a third of the rows share one value
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": rng.normal(size=3000)})), x


@pytest.mark.parametrize("limits", [(50_000, 10**6), (10, 10**6), (10, 50)])
def test_quantiles_are_exact_on_every_path(numbers, limits):
    df, x = numbers
    probs = [0.0, 0.01, 0.25, 0.3, 0.5, 0.8, 0.99, 1.0]
    got = ordering.quantile_row(df, {"x": probs, "y": [0.5]}, *limits).first()
    assert got["x"] == pytest.approx(np.quantile(x, probs), abs=1e-9)


def test_quantile_brackets_with_a_margin(spark):
    n = 120_000  # enough rows for the sketch error to leave a real bracket
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = ordering.quantile_row(df, {"x": [0.1, 0.5, 0.9]}, 10, 10**6).first()["x"]
    assert got == pytest.approx(np.quantile(np.arange(n), [0.1, 0.5, 0.9]))


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert ordering.quantile_row(df, {"x": [0.5]}).first()["x"] == [2.0]


def test_quantiles_are_found_however_narrow_the_bracket(spark):
    n = 60_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    got = sketches.exact_quantiles(df, {"x": [0.0, 0.37, 0.5, 1.0], "none": [0.5]},
                                   sketches.profile_parts(df, ["x", "none"], size=16), margin=1e-7)
    assert got["x"] == pytest.approx(np.quantile(np.arange(n), [0.0, 0.37, 0.5, 1.0])) and got["none"] == [None]


def test_profiles_of_parts_add_up(spark, numbers):
    df, x = numbers
    df = df.withColumn("day", F.when(F.col("x") < 60, F.floor(F.col("x") / 20)).cast("int"))  # NULL is a part, too
    gaps = df.select("day", F.when(F.col("y") > 0, F.col("x") + 1e9).alias("x"), F.lit(None).cast("double").alias("none"))
    stored = [sketches.profile_parts(gaps.where(f"day <=> {d}"), ["x", "none"], ["day"]) for d in (0, 1, 2, "NULL")]
    parts = stored[0]
    for part in stored[1:]:
        parts = parts.unionByName(part)  # a new part is profiled alone
    both = [{r["column"]: r for r in sketches.described(p).collect()}
            for p in (sketches.merge_profiles(parts), sketches.profile_parts(gaps, ["x", "none"]))]
    got, want = both[0]["x"], gaps.where("x IS NOT NULL").toPandas()["x"]
    assert (got.n_rows, got.n, got.min, got.max) == (3000, len(want), want.min(), want.max())
    assert got["mean"] == pytest.approx(want.mean(), rel=1e-14) and got["std"] == pytest.approx(want.std(), rel=1e-6)
    assert got.quantiles == both[1]["x"].quantiles  # few enough values for the sketch to keep them all
    assert [(p["none"].n, p["none"].quantiles, p["none"]["mean"]) for p in both] == [(0, None, None)] * 2


def test_describe_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    for df in (rows, rows.limit(0)):
        assert [tuple(r) for r in profile.describe(df, ["x"]).collect()] == [("x", 0, *[None] * 7)]


def test_running_totals_by_ranges_equal_one_window(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    one = ordering.running_totals(df, [F.col("k")], {"s": "n"}, 500)
    many = ordering.running_totals(df.repartition(5), [F.col("k")], {"s": "n"}, 500, single_task_rows=50)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_dense_codes_by_ranges(spark, rows):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "c", "a", "d"] * 3], "v string")
    want = [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(ordering.dense_codes(df, "v")) == want
    assert rows(ordering.dense_codes(df, "v", max_values=1)) == want


def test_top_k(spark):
    df = spark.createDataFrame([("a", -3.0), ("b", 2.0), ("c", 3.0)], "name string, v double")
    assert [r["name"] for r in ordering.top_k_by_abs(df, "v", "name", 2).collect()] == ["a", "c"]


def test_describe_matches_pandas(numbers):
    df, x = numbers
    got = {r["column"]: r for r in profile.describe(df, ["x", "y"]).collect()}["x"]
    want = pd.Series(x).describe()
    for a, b in [("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert got[a] == pytest.approx(want[b])


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    got = profile.histogram(df, "x", 5).collect()
    assert {r["bin"]: r["n"] for r in got} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(profile.histogram(flat, "x")) == [(1, 2)]


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "x double")
    r = profile.box_stats(df, "x").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)


def test_missing_profile(spark, rows):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    assert rows(profile.missing_profile(df)) == [("s", 1, 25.0), ("x", 2, 50.0)]


def test_correlation(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 1, 4, 3], "c": [4.0, 3, 2, 1]})
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(spark.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got[("a", "c")] == pytest.approx(-1) and got[("b", "a")] == pytest.approx(pdf.corr().loc["a", "b"])


def test_minmax_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["x"] for r in profile.minmax_normalize(df, "x").collect()] == [0.0, 0.0]


def test_correlations_of_many_columns_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 60)) @ rng.normal(size=(60, 60)) + 1e7  # means far beyond the deviations
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 9] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    table = profile.correlation_matrix(spark.createDataFrame(pdf).repartition(7), list(pdf.columns))
    got = table.toPandas().pivot(index="a", columns="b", values="corr").loc[pdf.columns, pdf.columns].to_numpy(float)
    want = pdf.corr().to_numpy()
    assert np.isnan(got[7]).all() and np.isnan(got[:, 9]).all()
    assert np.nanmax(np.abs(got - want)) < 1e-6 and (np.isnan(got) == np.isnan(want)).sum() >= 3600 - 60


def test_correlations_without_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in profile.correlation_matrix(empty, ["a", "b"]).collect()] == [None] * 4


def test_quantile_tiers_like_qcut(spark):
    values = [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r["v"]: r["tier"] for r in profile.quantile_tiers(df, "v").collect()}
    want = pd.qcut(pd.Series(values), [0, 0.5, 0.8, 1.0], labels=["Low", "Medium", "High"])
    assert [got[v] for v in values] == list(want) and got[None] is None


def test_quantile_tiers_refuse_equal_cuts(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    with pytest.raises(Exception, match="not unique"):
        profile.quantile_tiers(df, "v").collect()


def test_group_stats_and_semijoin(spark, rows):
    df = spark.createDataFrame([(1, 10.0, 2), (1, 30.0, 5), (2, 7.0, None), (None, 1.0, 1)], "u int, amount double, dev int")
    got = profile.attach_group_stats(df, "u", "amount", "dev").select("u", "user_mean_order", "user_order_count", "user_device_changes")
    assert rows(got) == [(1, 20.0, 2, 5), (1, 20.0, 2, 5), (2, 7.0, 1, None), (None, None, None, None)]
    keys = spark.createDataFrame([(1,), (1,)], "u int")
    assert profile.members_only(df, keys, "u").count() == 2


def test_type_selection(spark):
    df = spark.createDataFrame([(1, None, "s", True)], "i int, d double, s string, b boolean")
    assert profile.columns_of_type(df, "numeric") == ["i", "d"]
    assert profile.columns_of_type(df, "string") == ["s"]
    assert tuple(profile.numeric_matrix(df, exclude=["i"]).first()) == (0.0,)


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in profile.distinct_counts(df, "v").collect()] == [("v", 2)]
    flags = spark.createDataFrame([("x", 1), ("x", 0), ("y", 1)], "k string, f int")
    assert [tuple(r) for r in profile.segment_risk(flags, "k", "f").collect()] == [("y", 1.0, 1), ("x", 0.5, 2)]
    assert tuple(profile.positive_rate(flags, "f").first()) == (3, pytest.approx(2 / 3))
