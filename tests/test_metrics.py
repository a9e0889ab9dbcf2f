import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import metrics


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_regression(spark):
    y, p = np.array([3.0, -0.5, 2.0, 7.0]), np.array([2.5, 0.0, 2.0, 8.0])
    r = metrics.regression_metrics(frame(spark, y=y, p=p), "y", "p").first()
    assert (r["n"], r["r2"], r["rmse"], r["mae"]) == (
        4, pytest.approx(0.9486081370449679), pytest.approx(math.sqrt(0.375)), pytest.approx(0.5))


def test_regression_of_a_constant_has_no_r2(spark):
    assert metrics.regression_metrics(frame(spark, y=[1.0, 1.0], p=[0.0, 1.0]), "y", "p").first()["r2"] is None


def test_confusion_fills_zero_cells(spark):
    df = frame(spark, y=["cat", "cat", "dog"], p=["cat", "fox", "dog"])
    got = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9 and got[("cat", "cat")] == 1 and got[("cat", "fox")] == 1 and got[("fox", "fox")] == 0


def test_report(spark):
    df = frame(spark, y=[0, 1, 2, 2, 2], p=[0, 0, 2, 2, 1])
    got = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert (got["0"]["precision"], got["0"]["recall"], got["0"]["support"]) == (0.5, 1.0, 1)
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["f1"]) == (0.0, 0.0, 0.0)
    assert got["2"]["f1"] == pytest.approx(0.8)
    assert got["accuracy"]["f1"] == pytest.approx(0.6)
    assert got["macro avg"]["precision"] == pytest.approx(0.5)
    assert got["weighted avg"]["f1"] == pytest.approx((2 / 3 + 0 + 3 * 0.8) / 5)


def brute_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_auc_with_ties_on_both_paths(spark, limit):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    s[:100] = 0.5  # a third of the rows share one score
    df = frame(spark, y=y, s=s)
    assert metrics.roc_auc(df, "y", "s", limit).first()["auc"] == pytest.approx(brute_auc(y, s))
    curve = metrics.roc_curve(df, "y", "s", limit).orderBy(F.desc("threshold")).toPandas()
    assert len(curve) == len(set(s)) + 1 and math.isinf(curve["threshold"][0])
    assert (curve["fpr"].iloc[-1], curve["tpr"].iloc[-1]) == (1.0, 1.0)
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(brute_auc(y, s))


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(frame(spark, y=[1, 1], s=[0.1, 0.2]), "y", "s").first()["auc"] is None


def test_compare_keeps_each_models_own_numbers(spark):
    a, b = frame(spark, y=[1.0, 2.0], p=[1.0, 2.0]), frame(spark, y=[1.0, 2.0], p=[2.0, 1.0])
    got = metrics.compare_models({n: metrics.regression_metrics(d, "y", "p") for n, d in (("a", a), ("b", b))})
    assert {r["model"]: r["rmse"] for r in got.collect()} == {"a": 0.0, "b": 1.0}
