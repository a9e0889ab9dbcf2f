import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.models import estimators as E
from riskweave.models import gradient

NAMES = ["a", "b", "c"]


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float), "c": rng.exponential(size=n)})
    p = 1 / (1 + np.exp(-(2 * pdf.a + (pdf.b > 3) - pdf.c * (pdf.a > 0))))
    pdf["label"] = (rng.random(n) < p).astype(int)
    pdf["weight"] = rng.integers(0, 4, n) / 2
    pdf["is_val"] = rng.random(n) < 0.25
    return pdf


def assembled(df):
    return Pipeline(stages=E.preprocess_stages(NAMES, scale=False)).fit(df).transform(df)


def answers(model, df):
    return model.transform(df).select("id", vector_to_array("rawPrediction")[1], vector_to_array("probability")[1], "prediction").orderBy("id").toPandas().to_numpy()


@pytest.mark.parametrize("weight, validation", [(None, None), ("weight", None), (None, "is_val"), ("weight", "is_val")])
def test_same_trees_as_spark(spark, monkeypatch, weight, validation):
    monkeypatch.setattr(gradient, "TASK_ROWS", 300)  # several tasks
    ready = assembled(spark.createDataFrame(table(1500))).cache()
    est = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.2, seed=42)
    est = est.setWeightCol(weight) if weight else est
    theirs = (est.setParams(validationIndicatorCol=validation, validationTol=0.001) if validation else est).fit(ready)
    ours = E.gbt_classifier(rounds=12, depth=4, rate=0.2, weight=weight, validation=validation).fit(ready)
    assert ours.getNumTrees == theirs.getNumTrees and (validation is None or ours.getNumTrees <= 12)
    assert answers(ours, ready) == pytest.approx(answers(theirs, ready), abs=1e-9)


@pytest.mark.parametrize("most, jobs", [(gradient.JOINT_BYTES, 3), (0, 5)])
def test_a_job_for_two_levels_and_one_stage_per_job(spark, monkeypatch, most, jobs):
    calls, tracker = [], spark.sparkContext.statusTracker()
    real = gradient._sums

    def counted(blocks, ask, sizes):
        spark.sparkContext.setJobGroup(f"levels-{most}-{len(calls)}", "levels")
        calls.append(ask)
        return real(blocks, ask, sizes)

    monkeypatch.setattr(gradient, "_sums", counted)
    monkeypatch.setattr(gradient, "JOINT_BYTES", most)
    ready = assembled(spark.createDataFrame(table(1500))).cache()
    try:
        ours = E.gbt_classifier(rounds=3, depth=5, rate=0.2).fit(ready)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(calls) == 3 * jobs and all(len(a.nodes) <= 8 for a in calls)  # of 16 siblings one each is summed up
    own = [tracker.getJobIdsForGroup(f"levels-{most}-{i}") for i in range(len(calls))]
    assert all(len(j) == 1 and len(tracker.getJobInfo(j[0]).stageIds) == 1 for j in own)
    theirs = GBTClassifier(featuresCol="features", labelCol="label", maxIter=3, maxDepth=5, stepSize=0.2, seed=42).fit(ready)
    # In nodes of a few rows two columns can split equally well, and rounding decides.
    assert np.isclose(answers(ours, ready), answers(theirs, ready), atol=1e-9).all(axis=1).mean() > 0.99


def test_tasks_and_copies_do_not_change_the_trees(spark, monkeypatch):
    pdf = table(2000, 1)
    one = E.gbt_classifier(rounds=10, depth=4).fit(assembled(spark.createDataFrame(pdf)))
    monkeypatch.setattr(gradient, "TASK_ROWS", 300)
    monkeypatch.setattr(gradient, "BLOCK_ROWS", 100)
    ready = assembled(spark.createDataFrame(pdf))
    twice = E.gbt_classifier(rounds=10, depth=4).fit(ready.union(ready).repartition(5))
    assert answers(one, ready) == pytest.approx(answers(twice, ready), abs=1e-9)


def test_many_rows_reach_sparks_quality(spark):
    df = assembled(spark.createDataFrame(table(24_000, 2))).cache()
    train, test = df.where("NOT is_val"), df.where("is_val")
    ours = E.gbt_classifier(rounds=20, depth=4).fit(train)
    theirs = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.1, seed=42).fit(train)
    auc = [E.classifier_metrics(E.score(m, test)).first()["auc"] for m in (ours, theirs)]
    assert auc[0] == pytest.approx(auc[1], abs=0.003) and auc[0] > 0.8
    assert sum(ours.featureImportances) == pytest.approx(1)


def test_odd_rows(spark):
    pdf = table(60, 3)
    ready = assembled(spark.createDataFrame(pdf))
    alike = E.gbt_classifier(rounds=3, depth=2).fit(ready.withColumn("label", F.lit(1)))  # a single class
    assert all(r["prediction"] == 1 for r in alike.transform(ready).collect())
    same = assembled(spark.createDataFrame(pdf.assign(a=1.0, b=0.0, c=2.0)))  # nothing to split at
    assert E.gbt_classifier(rounds=3, depth=2).fit(same).transform(same).select("prediction").distinct().count() == 1
    for bad in (ready.withColumn("label", F.lit(2)), ready.withColumn("label", F.lit(None).cast("int")), ready.where("id < 0")):
        with pytest.raises(ValueError):
            E.gbt_classifier(rounds=2, depth=2).fit(bad)



def numbers_of(n, seed=0):
    return table(n, seed).assign(value=lambda d: 1e5 + 300 * d.a + 50 * d.b * (d.c > 1) + np.sin(9 * d.a + d.id))


@pytest.mark.parametrize("most", [gradient.JOINT_BYTES, 0])
def test_numbers_as_spark_in_few_jobs(spark, monkeypatch, most):
    calls = []
    real = gradient._sums
    monkeypatch.setattr(gradient, "_sums", lambda *a: calls.append(a[1]) or real(*a))
    monkeypatch.setattr(gradient, "JOINT_BYTES", most)
    monkeypatch.setattr(gradient, "TASK_ROWS", 300)
    ready = assembled(spark.createDataFrame(numbers_of(1500))).cache()
    ours = E.boosted_regressor("value", rounds=5, depth=4).fit(ready)
    theirs = E.gbt_regressor("value", rounds=5, depth=4).fit(ready)
    assert ours.getNumTrees == 5 and len(calls) == 5 * (2 if most else 4)
    a, b = (m.transform(ready).select("id", "prediction").orderBy("id").toPandas()["prediction"].to_numpy() for m in (ours, theirs))
    assert np.isclose(a, b, rtol=1e-9).mean() > 0.99
    assert sum(ours.featureImportances) == pytest.approx(1)


def test_numbers_weighted_stopped_and_stored(spark, tmp_path, rows):
    ready = assembled(spark.createDataFrame(numbers_of(1500))).cache()
    theirs = E.gbt_regressor("value", rounds=8, depth=4, rate=0.9).setWeightCol("weight").setParams(validationIndicatorCol="is_val", validationTol=0.001).fit(ready)
    est = gradient.GradientTrees("features", "value", 8, 4, 0.9, weight="weight", validation="is_val", classes=False)
    ours = est.fit(ready)
    assert ours.getNumTrees == theirs.getNumTrees
    a, b = (m.transform(ready).select("id", "prediction").orderBy("id").toPandas()["prediction"].to_numpy() for m in (ours, theirs))
    assert np.isclose(a, b, rtol=1e-9).mean() > 0.99
    ours.write().save(str(tmp_path / "m"))
    back = gradient.GradientTreesModel.read().load(str(tmp_path / "m"))
    assert rows(back.transform(ready).select("id", "prediction")) == rows(ours.transform(ready).select("id", "prediction"))
    assert "probability" not in back.transform(ready).columns


def test_numbers_far_from_zero_and_odd_ones(spark):
    ready = assembled(spark.createDataFrame(numbers_of(300)))
    far = ready.withColumn("value", F.col("value") + 1e12)  # their squares have no digits left for what tells them apart
    near, away = (E.boosted_regressor("value", rounds=3, depth=3).fit(d).transform(d).orderBy("id").toPandas()["prediction"].to_numpy() for d in (ready, far))
    assert away - 1e12 == pytest.approx(near, abs=0.01)
    alike = E.boosted_regressor("value", rounds=3, depth=2).fit(ready.withColumn("value", F.lit(7.5)))
    assert all(r["prediction"] == 7.5 for r in alike.transform(ready).collect())
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            E.boosted_regressor("value", rounds=2, depth=2).fit(ready.withColumn("value", F.lit(bad).cast("double")))
