"""Forests of bounded depth: histograms against plain sums, splits against trying every cut, and stored models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.models import boosting as B
from riskweave.models import ensembles as N
from riskweave.models import estimators as E
from riskweave.models import store
from riskweave.models.boosting import Block, Growing


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(900), "a": rng.normal(size=900), "b": rng.integers(0, 4, 900).astype(float), "c": rng.random(900)})
    pdf["label"] = ((pdf.a > 0.2) ^ (pdf.b == 2)).astype(int)
    pdf["value"] = 3.0 * (pdf.a > 0.2) + pdf.b
    pdf["w"] = rng.uniform(0.5, 2, 900)
    return spark.createDataFrame(pdf).cache()


def test_histograms_are_sums_over_the_bag():
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 5, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300).astype(float), rng.uniform(0.5, 2, 300)
    block = Block(x, y, w, np.ones((300, 1), bool), np.zeros((300, 1)))
    g = Growing()
    g.split(0, 1, 2, (1.0, 0.0), (1.0, 0.0), 9)
    drawn = np.array([[0, 2], [2, 1]])
    got = N.histograms(block, (4, 1), 7, 11, g.arrays(), [1, 2], drawn, 5)
    bag = N.bag(7, 11, (4, 1), 300) * w
    for k, rows in enumerate((x[:, 1] <= 2, x[:, 1] > 2)):
        for j, f in enumerate(drawn[k]):
            for b in range(5):
                here = rows & (x[:, f] == b)
                assert got[k, j, b] == pytest.approx([bag[here].sum(), (bag * y)[here].sum()])


def test_bags_hold_a_row_once_on_average():
    counts = np.bincount(N.BAG.astype(int), minlength=4) / N.CHANCE
    assert N.BAG.mean() == pytest.approx(1, abs=1e-3) and counts[:3] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=1e-4)


@pytest.mark.parametrize("room", [1, 32_000_000])
def test_finds_the_rule_whatever_the_groups_of_trees(spark, table, monkeypatch, room):
    monkeypatch.setattr(N, "HISTOGRAM_BYTES", room)
    ready = Pipeline(stages=E.preprocess_stages(["a", "b", "c"], scale=False)).fit(table).transform(table)
    model = E.random_forest_classifier(trees=12, depth=6, weight="w").fit(ready)
    scored = model.transform(ready)
    assert scored.where("prediction = label").count() > 880 and model.getNumTrees == 12
    both = scored.select(vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("r"), "prediction")
    assert all(sum(r.p) == pytest.approx(1) and sum(r.r) == pytest.approx(12) and r.prediction == (r.p[1] > 0.5) for r in both.collect())
    assert sum(model.featureImportances.toArray()) == pytest.approx(1) and model.featureImportances[2] < 0.1
    assert max(len(t.feature) for t in model.trees) < 2**7


def test_groups_of_trees_give_the_same_forest(table, monkeypatch):
    ready = Pipeline(stages=E.preprocess_stages(["a", "b", "c"], scale=False)).fit(table).transform(table)
    fit = lambda: [t.parts() for t in E.random_forest_regressor("value", trees=3, depth=3).fit(ready).trees]
    whole = fit()
    monkeypatch.setattr(N, "HISTOGRAM_BYTES", 1)
    assert fit() == whole


def test_regression_and_storage(table, tmp_path, rows):
    model = Pipeline(stages=[*E.preprocess_stages(["a", "b", "c"]), E.random_forest_regressor("value", trees=10, depth=6)]).fit(table)
    got = model.transform(table)
    assert got.agg(F.max(F.abs(F.col("prediction") - F.col("value")))).first()[0] < 1.5
    store.save_model(model, str(tmp_path / "m"))
    assert rows(store.load_model(str(tmp_path / "m")).transform(table).select("id", "prediction")) == rows(got.select("id", "prediction"))


def test_refuses_other_labels(table):
    ready = Pipeline(stages=E.preprocess_stages(["a"])).fit(table).transform(table)
    with pytest.raises(ValueError):
        E.random_forest_classifier("b", trees=2).fit(ready)


@pytest.mark.parametrize("weight, columns", [(None, None), ("w", 3)])
def test_trees_grown_by_one_task_are_those_of_the_levels(table, monkeypatch, weight, columns):
    """Blocks that fit are sent once, so a forest takes a few jobs instead of a shuffle for each level and group of trees."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    ready = Pipeline(stages=E.preprocess_stages(["a", "b", "c"], scale=False)).fit(table).transform(table).repartition(3, "id")
    spark, context, jobs = table.sparkSession, table.sparkSession.sparkContext, []
    forests = []
    for most in (N.SENT_BYTES, 0):
        monkeypatch.setattr(N, "SENT_BYTES", most)
        for label, classes in (("label", True), ("value", False)):
            context.setJobGroup(f"forest-{most}-{label}-{weight}-{columns}", "forest")
            try:
                forests.append(N.RandomForest("features", label, 6, 7, 42, classes, weight, columns).fit(ready))
            finally:
                spark.sparkContext._jsc.clearJobGroup()
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{most}-{label}-{weight}-{columns}")))
    assert jobs[0] <= jobs[2] - 4 and jobs[1] <= jobs[3] - 4
    for one, other in ((forests[0], forests[2]), (forests[1], forests[3])):
        both = one.transform(ready).select("id", F.col("prediction").alias("p")).join(other.transform(ready).select("id", "prediction"), "id")
        assert both.where("abs(p - prediction) < 1e-9").count() > 880  # equally good splits are told apart by rounding
        assert [sum(t.cover[:1]) for t in one.trees] == pytest.approx([sum(t.cover[:1]) for t in other.trees])
        if weight is None and one is forests[0]:
            assert [t.parts() for t in one.trees] == [t.parts() for t in other.trees]  # whole numbers: no rounding


def test_few_values_are_sent_as_codes():
    for values in (np.array([2.5, 0.0, 2.5]), np.arange(600.0)):
        assert N._unpacked(*N.packed(values)).tolist() == values.tolist()
    assert N.packed(np.zeros(600))[1].dtype == np.uint8 and N.packed(np.arange(600.0))[1] is None
