import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from riskweave.models import estimators as E
from riskweave.models import runs


def test_predictions_become_tiers_and_actions(spark):
    """Twice the feature is learnt exactly; NULL churn is no risk."""
    df = spark.range(1, 11).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"),
                                   F.when(F.col("id") == 10, None).otherwise(F.col("id") / 10.0).alias("churn"))
    model = Pipeline(stages=[*E.preprocess_stages(["x"], scale=False), E.linear_regression()]).fit(df)
    got = {r["id"]: (round(r["predicted"], 3), r["tier"], r["action"]) for r in runs.value_actions(model, df, "churn").collect()}
    assert [got[i][1] for i in range(1, 11)] == ["Low"] * 5 + ["Medium"] * 3 + ["High"] * 2
    assert got[9] == (18.0, "High", "Retention Priority") and got[10][2] == "Upsell/Cross-sell"
    assert got[6][2] == "Upsell/Cross-sell" and got[1][2] == "Low-cost Nurture"


def test_flags_measured_per_model_and_group(spark):
    data = [(1, 0.9, 0.1, "a"), (1, 0.5, 0.2, "a"), (0, 0.4, 0.9, "b"), (0, 0.6, 0.3, None)]
    df = spark.createDataFrame(data, "label int, p double, q double, g string")
    got = {r["model"]: r for r in runs.evaluate_flags(df, {"P": "p", "Q": "q"}).collect()}
    assert [got["P"][c] for c in ("n", "tn", "fp", "fn", "tp", "accuracy", "recall")] == [4, 1, 1, 0, 2, 0.75, 1.0]
    assert got["P"]["auc"] == 0.75 and got["Q"]["auc"] == 0.0 and got["Q"]["tp"] == 0 and got["Q"]["f1"] == 0.0
    rates = {(r["part"], r["value"]): (r["n"], r["rate"]) for r in runs.flag_rates(df, ["g", "label"], "p").collect()}
    assert rates[("g", "a")] == (2, pytest.approx(0.7)) and rates[("g", None)] == (1, 0.6) and rates[("label", "0")] == (2, 0.5)
    assert runs.flag_rates(df.where("false"), ["g"], "p").count() == 0
    with pytest.raises(ValueError):
        runs.evaluate_flags(df, {})
