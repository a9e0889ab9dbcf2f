import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.models import estimators as E
from riskweave.models import explain, isolation, store
from riskweave.operators import metrics, sampling


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "income": rng.normal(50, 10, n), "debt": rng.random(n), "kind": rng.choice(["x", "y", "z"], n)})
    p = 1 / (1 + np.exp(-(6 * pdf.debt - 3 + (pdf.kind == "z"))))
    pdf["label"] = (rng.random(n) < p).astype(int)
    pdf["value"] = 3 * pdf.income - 20 * pdf.debt + 5 * (pdf.kind == "y")
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def prepared(loans):
    return Pipeline(stages=E.preprocess_stages(["income", "debt"], ["kind"])).fit(loans)


def test_preprocessing(spark, loans, prepared):
    ready = prepared.transform(loans)
    names = E.feature_names(ready)
    assert names == ["income_z", "debt_z", "kind_hot_x", "kind_hot_y", "kind_hot_z"]
    z = ready.select(F.avg("income_z"), F.stddev_pop("income_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    new = spark.createDataFrame([(50.0, 0.5, "never seen")], "income double, debt double, kind string")
    assert list(prepared.transform(new).first()["features"].toArray()[2:]) == [0.0, 0.0, 0.0]


def test_linear_model_recovers_the_rule(spark, loans, prepared):
    ready = prepared.transform(loans)
    fitted = E.linear_regression("value").fit(ready)
    r = metrics.regression_metrics(fitted.transform(ready), "value", "prediction").first()
    assert r["r2"] == pytest.approx(1.0)
    top = explain.coefficients(spark, fitted, E.feature_names(ready), 2).collect()
    assert top[0]["feature"] == "income_z" and len(top) == 2


def test_classifiers_importance_and_scores(spark, loans, prepared):
    ready = prepared.transform(loans)
    forest = E.random_forest_classifier(trees=15, depth=4).fit(ready)
    logit = E.logistic_regression(400).fit(ready)
    boosted = E.gbt_classifier(rounds=5, depth=3).fit(ready)
    for m in (forest, logit, boosted):
        r = E.classifier_metrics(E.score(m, ready)).first()
        assert 0.7 < r["auc"] <= 1 and r["n"] == 400
    imp = explain.feature_importance(spark, forest, E.feature_names(ready)).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1) and imp[0]["feature"] == "debt_z"


def test_logistic_matches_the_penalised_optimum(loans, prepared):
    ready = prepared.transform(loans)
    m = E.logistic_regression(400).fit(ready)
    rows = ready.select("features", "label").collect()
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows], float)
    w = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + m.intercept)))
    assert x.T @ (p - y) + w == pytest.approx(np.zeros(len(w)), abs=0.5)  # gradient of 0.5|w|^2 + sum of losses


def test_applicants(loans):
    stages = E.preprocess_stages(["income", "debt"], ["kind"])
    models = {"Linear Regression": Pipeline(stages=[*stages, E.linear_regression()]).fit(loans),
              "Random Forest": Pipeline(stages=[*stages, E.random_forest_classifier(trees=10, depth=4)]).fit(loans)}
    got = E.score_applicants(loans, models, "id").toPandas()
    assert len(got) == 800 and got["default_probability"].between(0, 1).all()
    assert set(got["risk_bucket"]) <= {"Accept", "Review", "Reject"}
    assert ((got["default_probability"] > 0.5) <= (got["predicted_default"] == "Yes")).all()


def test_saved_model_predicts_the_same(loans, tmp_path, rows):
    model = Pipeline(stages=[*E.preprocess_stages(["income", "debt"], ["kind"]), E.gbt_classifier(rounds=3, depth=3)]).fit(loans)
    store.save_model(model, str(tmp_path / "m"))
    again = store.load_model(str(tmp_path / "m"))
    assert rows(E.score(model, loans).select("id", "p")) == rows(E.score(again, loans).select("id", "p"))


def test_grid_search(spark, loans):
    folded = sampling.kfold(loans, "id", 3)
    est = E.gbt_regressor("value", rounds=2, depth=2)
    search = E.grid_search(E.preprocess_stages(["income", "debt"], ["kind"]), est, {"maxDepth": [1, 3]}, "fold", label="value")
    got = E.grid_results(search.fit(folded), spark).collect()
    assert len(got) == 2 and sum(r["is_best"] for r in got) == 1
    best = next(r for r in got if r["is_best"])
    assert "maxDepth=3" in best["params"] and best["mean_r2"] == max(r["mean_r2"] for r in got)


def test_early_stopping_uses_the_validation_rows(loans, prepared):
    ready = prepared.transform(loans).withColumn("is_val", F.col("id") % 4 == 0)
    stopped = E.gbt_classifier(rounds=40, depth=2, validation="is_val").fit(ready)
    assert stopped.getNumTrees < 40


# ---------------------------------------------------------------- isolation forest

@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(1000, 2)), [[9.0, 9.0], [-8.0, 9.0]]])
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]})).cache()


def test_isolation_finds_the_outliers(cloud, tmp_path, rows):
    forest = isolation.fit_isolation_forest(cloud, "id", ["a", "b"], trees=40, sample=64)
    scored = forest.flag(cloud)
    assert [r["id"] for r in scored.orderBy(F.desc("iso_score")).limit(2).collect()] in ([1000, 1001], [1001, 1000])
    assert scored.agg(F.min("iso_score"), F.max("iso_score")).first() == pytest.approx((0, 1), abs=1e-6)
    forest.save(str(tmp_path / "f"))
    again = isolation.IsolationForestModel.load(cloud.sparkSession, str(tmp_path / "f"))
    assert rows(again.score(cloud)) == rows(forest.score(cloud))


def test_isolation_draws_from_rows_left_by_a_split_with_its_seed(spark):
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("label"))
    train = sampling.stratified_split(df, "id", "label", 0.5, seed=42).where("is_test = 0")
    assert len(isolation.fit_isolation_forest(train, "id", ["a"], trees=8, sample=16).trees) == 8


def test_isolation_does_not_depend_on_layout(cloud, rows):
    a = isolation.fit_isolation_forest(cloud, "id", ["a", "b"], trees=10, sample=32)
    b = isolation.fit_isolation_forest(cloud.repartition(7), "id", ["a", "b"], trees=10, sample=32)
    assert rows(a.score(cloud)) == rows(b.score(cloud)) and len(a.trees) == 10


def test_isolation_on_tiny_and_constant_data(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, a double")
    forest = isolation.fit_isolation_forest(df, "id", ["a"], trees=7, sample=256)
    assert len(forest.trees) == 7
    assert len({r["anomaly"] for r in forest.score(df).collect()}) == 1


# ---------------------------------------------------------------- attributions

def test_linear_attribution_adds_up(loans):
    w = {"income": 3.0, "debt": -20.0}
    got = explain.linear_attribution(loans, w).select(
        (F.col("phi_income") + F.col("phi_debt")).alias("phi"), (3.0 * F.col("income") - 20.0 * F.col("debt")).alias("f")).toPandas()
    assert got["phi"].to_numpy() == pytest.approx((got["f"] - got["f"].mean()).to_numpy())


def brute_shapley(nodes, x, width):
    """Shapley values over all coalitions, walking the tree by training shares off the coalition."""
    import itertools
    import math

    def value(at, known):
        node = nodes[at]
        if node["left"] < 0:
            return node["value"]
        if node["feature"] in known:
            return value(node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], known)
        parts = [(nodes[c]["cover"] / node["cover"], c) for c in (node["left"], node["right"])]
        return sum(w * value(c, known) for w, c in parts)

    phi = np.zeros(width)
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for size in range(width):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                phi[i] += w * (value(0, {*s, i}) - value(0, set(s)))
    return phi


def test_forest_attribution_equals_all_coalitions(spark, loans, prepared):
    ready = prepared.transform(loans)
    names = E.feature_names(ready)
    forest = E.random_forest_classifier(trees=4, depth=4).fit(ready)
    few = ready.where("id < 12")
    got = {r["id"]: np.array(r["phi"]) for r in explain.forest_attribution(forest, few, "id", names).collect()}
    trees = explain.forest_nodes(forest, spark)
    base = explain.forest_base_value(trees)
    for r in forest.transform(few).select("id", "features", vector_to_array("probability")[1].alias("p")).collect():
        x = r["features"].toArray()
        want = np.mean([brute_shapley(t, x, len(names)) for t in trees], axis=0)
        assert got[r["id"]] == pytest.approx(want, abs=1e-9)
        assert base + got[r["id"]].sum() == pytest.approx(r["p"], abs=1e-9)
    summary = explain.attribution_summary(explain.forest_attribution(forest, ready, "id", names), names).collect()
    assert max(summary, key=lambda r: r["mean_abs"])["feature"] == "debt_z"


def test_attributions_of_many_rows_walk_no_tree(spark, loans, prepared, monkeypatch):
    """Keys that repeat or are missing stay as they are, and rows of one bin may meet in several tasks."""
    ready = prepared.transform(loans)
    names = E.feature_names(ready)
    forest = E.random_forest_classifier(trees=3, depth=4).fit(ready)
    odd = ready.select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "features").limit(60).cache()
    answer = lambda: sorted((-1 if r["k"] is None else r["k"], *np.round(r["phi"], 9) + 0.0) for r in explain.forest_attribution(forest, odd, "k", names).collect())
    monkeypatch.setattr(explain, "TABLE_BYTES", 0)
    walked = answer()

    def refuse(*_):
        raise AssertionError("walked")

    monkeypatch.setattr(explain, "tree_attributions", refuse)
    monkeypatch.setattr(explain, "TABLE_BYTES", 256_000_000)
    monkeypatch.setattr(explain, "PIECE_ROWS", 2)
    tables = answer()
    assert len(tables) == 60 and np.array(tables) == pytest.approx(np.array(walked), abs=1e-8)
    assert explain.forest_attribution(forest, odd.where("k > 99"), "k", names).collect() == []


# ---------------------------------------------------------------- text models

def test_intents_and_embeddings(spark):
    data = [(i, t, y) for i, (t, y) in enumerate([("where is my order", "order"), ("refund my money", "refund")] * 20)]
    df = spark.createDataFrame(data, "id int, text string, intent string")
    rows = E.with_words(df, "text")
    model = Pipeline(stages=E.intent_stages("intent", 40)).fit(rows)
    assert model.transform(rows).where("label = prediction").count() == 40
    other = spark.createDataFrame([(99, "where is my money", "order")], "id int, text string, intent string")
    embedder = E.fit_embedder(df.unionByName(other), "text", dim=32)
    v = np.array(E.embed_text(embedder, df.limit(1), "text").first()["embedding"])
    assert len(v) == 32 and np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
