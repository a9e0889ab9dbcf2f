import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import arrays as A
from riskweave.functions import columns as C
from riskweave.functions import text as X


def col(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_map_values_leaves_unknown_null(spark):
    assert col(spark, ["Yes", "No", "maybe", None], C.map_values("x", {"Yes": 1, "No": 0}), "string") == [1, 0, None, None]


def test_clip_keeps_null(spark):
    assert col(spark, [-1.0, 0.5, 9.0, None], C.clip("x", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert col(spark, [-1.0, 9.0], C.clip("x", lo=0.0)) == [0.0, 9.0]


def test_swap_label_rule(spark):
    df = spark.createDataFrame(
        [(4, 0, "postpaid", 9.0), (0, 6, "postpaid", 9.0), (0, 0, "prepaid", 0.4), (0, 0, "postpaid", 0.4),
         (3, 5, "prepaid", 0.5), (None, None, None, None)], "d int, l int, p string, u double")
    got = [r[0] for r in df.select(C.swap_fraud_label(F.col("d"), F.col("l"), F.col("p"), F.col("u"))).collect()]
    assert got == [1, 1, 1, 0, 0, 0]


def test_ratio_modes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (1.0, -1.0), (1.0, None)], "n double, d double")
    assert [r[0] for r in df.select(C.safe_ratio("n", "d")).collect()] == [0.0, 0.25, -1.0, None]
    assert [r[0] for r in df.select(C.safe_ratio("n", "d", "plus_one")).collect()] == [1.0, 0.2, None, None]
    with pytest.raises(ValueError):
        C.safe_ratio("n", "d", "other")


def test_bucket_edges(spark):
    left = C.risk_bucket("x", [0.3, 0.7], ["a", "b", "c"], "left")
    right = C.risk_bucket("x", [0.3, 0.7], ["a", "b", "c"], "right")
    values = [0.29, 0.3, 0.7, 0.71, None]
    assert col(spark, values, left) == ["a", "b", "c", "c", None]
    assert col(spark, values, right) == ["a", "a", "b", "c", None]
    with pytest.raises(ValueError):
        C.risk_bucket("x", [0.7, 0.3], ["a", "b", "c"])


def test_velocity_and_threshold_treat_missing_as_no_evidence(spark):
    assert col(spark, [3.0, 2.0, None], C.velocity_flag(F.col("x"))) == [1, 0, 0]
    assert col(spark, [2.0, 1.0, None], C.velocity_flag(None, F.col("x"))) == [1, 0, 0]
    assert col(spark, [9.0], C.velocity_flag()) == [0]
    assert col(spark, [2.0, 3.0, None], C.threshold_flag("x", 2)) == [0, 1, 0]


def test_calendar(spark):
    got = col(spark, ["2024-01-01 13:05:00", "2024-01-07 00:00:00", "no date"],
              F.struct(C.hour_of(C.parse_time("x")), C.weekday_of(C.parse_time("x"))), "string")
    assert [tuple(g) for g in got] == [(13, 0), (0, 6), (None, None)]


def test_recommend(spark):
    df = spark.createDataFrame([("High", 0.6), ("High", 0.5), ("Medium", 0.9), ("Low", 0.9), ("High", None), (None, 1.0)], "t string, c double")
    assert [r[0] for r in df.select(C.recommend_action("t", "c")).collect()] == [
        "Retention Priority", "Upsell/Cross-sell", "Upsell/Cross-sell", "Low-cost Nurture", "Upsell/Cross-sell", "Low-cost Nurture"]


def test_weighted_score(spark):
    df = spark.createDataFrame([(2.0, 3.0, "x"), (-9.0, 1.0, "y"), (None, 1.0, "x")], "a double, b double, s string")
    score = C.weighted_score({"a": 1.0}, {("s", "x"): 10.0}, {("a", "b"): 0.5}, intercept=1.0)
    assert [r[0] for r in df.select(score).collect()] == [16.0, 0.0, None]


def test_hash_draw_is_uniform_and_stable(spark):
    df = spark.range(20_000).select(C.hash_unit("id", seed=1).alias("u"))
    mean, lo, hi = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(mean - 0.5) < 0.01 and 0 <= lo and hi < 1
    assert df.repartition(7).agg(F.sum(F.round("u", 6))).first()[0] == pytest.approx(df.agg(F.sum(F.round("u", 6))).first()[0])


def test_clean_and_tokenize(spark):
    assert col(spark, ["Don't STOP, now!", "É1 b", "", None], X.clean_text("x"), "string") == ["dont stop now", " b", "", None]
    assert col(spark, ["  a \t b\n c ", "", None], X.tokenize("x"), "string") == [["a", "b", "c"], [], None]
    assert col(spark, [" \n a b \x1f", "  "], X.strip("x"), "string") == ["a b", ""]


def test_paragraphs_and_padding(spark):
    assert col(spark, ["a\n\n \n\nb c\nd", "x"], F.struct(X.count_paragraphs("x"), X.count_words("x")), "string") == [(2, 4), (1, 1)]
    assert col(spark, [[1, 2], [], list(range(12))], X.pad_truncate("x", 10), "array<int>") == [
        [1, 2] + [0] * 8, [0] * 10, list(range(10))]


def test_render_prompt(spark):
    df = spark.createDataFrame([("why?", "text {question} $1"), (None, "c")], "question string, context string")
    out = X.render_prompt("C: {context} Q: {question}!", {"context": "context", "question": "question"})
    assert [r[0] for r in df.select(out).collect()] == ["C: text {question} $1 Q: why?!", "C: c Q: !"]
    with pytest.raises(KeyError):
        X.render_prompt("{nothing}", {})


def test_layers_match_arithmetic(spark):
    w, b = [[0.5, -1.0], [0.25, 2.0], [1.0, 0.0]], [0.1, -0.2]
    x = [1.0, 2.0, -3.0]
    z = [sum(x[i] * w[i][j] for i in range(3)) + b[j] for j in range(2)]
    got = col(spark, [x], F.struct(A.dense_layer("x", w, b), A.sigmoid(A.dense_layer("x", w, b)), A.relu(A.dense_layer("x", w, b)),
                                   A.tanh(A.dense_layer("x", w, b)), A.softmax(A.dense_layer("x", w, b))), "array<double>")[0]
    e = [math.exp(v - max(z)) for v in z]
    assert got[0] == pytest.approx(z)
    assert got[1] == pytest.approx([1 / (1 + math.exp(-v)) for v in z])
    assert got[2] == pytest.approx([max(v, 0) for v in z])
    assert got[3] == pytest.approx([math.tanh(v) for v in z])
    assert got[4] == pytest.approx([v / sum(e) for v in e])


def test_wide_layer_takes_the_folding_path(spark):
    x = [float(i) for i in range(40)]
    w = [[(i + j) / 7.0 for j in range(3)] for i in range(40)]
    got = col(spark, [x], A.layers("x", [(w, [1.0, 2.0, 3.0], A.relu)]), "array<double>")[0]
    assert got == pytest.approx([sum(x[i] * w[i][j] for i in range(40)) + j + 1.0 for j in range(3)])


def test_softmax_does_not_overflow(spark):
    assert col(spark, [[1000.0, 1000.0]], A.softmax("x"), "array<double>") == [[0.5, 0.5]]


def test_argmax_one_hot_loss(spark):
    assert col(spark, [[0.2, 0.4, 0.4]], A.argmax("x"), "array<double>") == [1]
    assert col(spark, [2, None, 7], A.one_hot("x", 3), "int") == [[0, 0, 1], [0, 0, 0], [0, 0, 0]]
    assert col(spark, [[0.25, 0.75]], A.log_loss(F.lit(1), "x"), "array<double>")[0] == pytest.approx(-math.log(0.75 + 1e-9))
    assert col(spark, [[0.0, 255.0]], A.rescale("x", 255), "array<double>") == [[0.0, 1.0]]
    assert col(spark, [[1.0, 2.0]], A.squared_distance("x", F.array(F.lit(0.0), F.lit(0.0))), "array<double>") == [5.0]


def test_word_profile_hashes_every_word_once(spark):
    import hashlib

    texts = ["", "a", "the cat sat on the mat", "x y z " * 30, None]
    for buckets in (16, 3):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", X.word_profile("text", buckets).alias("v"))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 1
        for i, got in df.collect():
            digits = [int(hashlib.md5(w.encode()).hexdigest()[0], 16) % buckets for w in (texts[i] or "").split()]
            want = [None if texts[i] is None else digits.count(b) * 1000 // max(1, len(digits)) for b in range(buckets)]
            assert got == want
