import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import sequences as S


@pytest.fixture(scope="module")
def payments(spark):
    rng = random.Random(5)
    data = []
    for key in range(12):
        for i in range(rng.choice([3, 6, 7, 8, 20])):
            data.append((key, rng.randrange(30), len(data), rng.randrange(2), float(i % 3)))
    for i in range(400):  # one key with many rows, many of them on the same day
        data.append((99, rng.choice([5, 5, 5, rng.randrange(30)]), len(data), rng.randrange(2), float(i % 3)))
    return spark.createDataFrame(data, "key int, day int, id int, on_time int, late double"), data


def brute(data, length=6):
    out = []
    for key in {d[0] for d in data}:
        group = sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))
        for i in range(length, len(group)):
            out.append((group[i][2], 0 if group[i][3] == 1 else 1, [g[2] for g in group[i - length:i]]))
    return sorted(out)


@pytest.mark.parametrize("key_rows", [10**6, 30, 1])
def test_windows_on_both_paths(payments, key_rows):
    df, data = payments
    got = S.sliding_sequences(df, "key", ["day", "id"], {"id": F.col("id"), "late": F.col("late")}, 6,
                              key_rows=key_rows, slice_rows=max(key_rows // 2, 5))
    found = sorted((r["id"], r["label"], [s["id"] for s in r["seq"]]) for r in got.withColumn(
        "label", S.next_step_label(F.col("on_time"))).collect())
    assert found == brute(data)


def test_mask_and_flatten(spark):
    df = spark.createDataFrame([([(0, 0.0), (1, 0.0), (0, 2.0)],)], "seq array<struct<a:int,b:double>>")
    r = df.select(S.mask_steps("seq", ["a", "b"]).alias("m"), S.flatten_steps("seq", ["a", "b"]).alias("f")).first()
    assert [tuple(s) for s in r["m"]] == [(1, 0.0), (0, 2.0)] and r["f"] == [0.0, 0.0, 1.0, 0.0, 0.0, 2.0]


def test_min_history(payments):
    df, data = payments
    sizes = {k: sum(d[0] == k for d in data) for k in {d[0] for d in data}}
    assert S.min_history(df, "key", 7).count() == sum(n for n in sizes.values() if n >= 7)


@pytest.mark.parametrize("key_rows", [10**6, 20])
def test_velocity_on_both_paths(spark, key_rows):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(600):
        key = None if i % 97 == 0 else rng.choice([1, 1, 1, 2, 3])
        ts = None if i % 89 == 0 else start + dt.timedelta(seconds=rng.choice([0, 1, 900, 3600]) * rng.randrange(60))
        data.append((i, key, ts))
    df = spark.createDataFrame(data, "id int, k int, ts timestamp_ntz")
    got = S.velocity_counts(df, "k", "ts", {"n_day": 86_400, "n_hour": 3_600}, key_rows=key_rows).collect()
    assert len(got) == len(data)
    for r in got:
        def count(seconds):
            if r["k"] is None or r["ts"] is None:
                return None
            low = r["ts"] - dt.timedelta(seconds=seconds)
            return sum(k == r["k"] and t is not None and low <= t <= r["ts"] for _, k, t in data)
        assert (r["n_day"], r["n_hour"]) == (count(86_400), count(3_600))


@pytest.mark.parametrize("key_rows", [10**6, 10])
def test_velocity_takes_any_horizon(spark, key_rows):
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(microseconds=i * 250_000) for i in range(40)] + [start] * 30
    df = spark.createDataFrame([(1, t) for t in times], "k int, ts timestamp_ntz")
    got = S.velocity_counts(df, "k", "ts", {"n": 7, "m": 1}, key_rows=key_rows, slice_rows=8).collect()
    for r in got:
        for name, seconds in (("n", 7), ("m", 1)):
            low = r["ts"] - dt.timedelta(seconds=seconds)
            assert r[name] == sum(low <= t <= r["ts"] for t in times)


def test_burst_of_one_key_is_cut_into_slices_of_bounded_size(spark):
    """A third of the table lies on one key within one second, half of that in one instant."""
    rows = 300_000
    df = spark.range(rows, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"), "id",
        F.timestamp_micros(F.when(F.col("id") % 6 == 0, F.lit(500_000)).otherwise(F.col("id") * 7919 % 1_000_000)).alias("ts"))
    hot = df.where("k = -1")
    cut = S.cut_by_rows(hot, "k", ["ts", "id"], rows // 3, 5_000)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 15_000 and sum(sizes) == rows // 3

    got = S.sliding_sequences(df, "k", ["ts", "id"], {"id": F.col("id")}, 3, key_rows=10_000, slice_rows=5_000)
    plain = S.sliding_sequences(df, "k", ["ts", "id"], {"id": F.col("id")}, 3)
    key = F.sum(F.xxhash64("id", "k", F.transform("seq", lambda e: e["id"])).cast("decimal(30, 0)")).alias("h")
    assert got.agg(F.count("*"), key).first() == plain.agg(F.count("*"), key).first()

    counts = S.velocity_counts(df, "k", "ts", {"n": 1}, key_rows=10_000, slice_rows=5_000)
    assert counts.count() == rows
    moments = hot.groupBy("ts").agg(F.count("*").alias("c")).orderBy("ts").toPandas()
    upto = dict(zip(moments["ts"], moments["c"].cumsum()))  # all within one second, so everything before counts
    found = counts.where("k = -1").select("ts", "n").distinct().toPandas()
    assert len(found) == len(moments) and all(upto[r.ts] == r.n for r in found.itertuples())


@pytest.mark.parametrize("key_rows", [10**6, 1])
def test_velocity_ignores_clock_changes_of_the_session_zone(spark, key_rows):
    """The night Berlin's clocks went forward: plain times stay an hour apart."""
    times = [dt.datetime(2024, 3, 31, h) for h in (1, 2, 3, 4)]
    df = spark.createDataFrame([(1, t) for t in times], "k int, ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = S.velocity_counts(df, "k", "ts", {"n": 3_600}, key_rows=key_rows).orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["n"] for r in got] == [1, 2, 2, 2]
