"""Models: fitted on whole tables, checked by their numbers.

Fraud and value models, importances, attributions and the scoring run use the full tree counts. The grid and the late-payment
model use fewer trees than the estimators' defaults, so that a run takes seconds.
"""

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..functions.columns import hash_int, relative_deviation, weekday_of
from ..models import estimators as E
from ..models import boosting, explain, forest, isolation, latent, store
from ..operators import answers, metrics, neighbours, ordering, prepare, profile, sampling
from ..operators import sequences as S
from ..session import cached, materialize, shared_dir
from ..sources import files
from . import sequences as seq_plans
from .columns import device_changes
from .profiling import rounded, spend
from .registry import hash_sql, query
from .texts import CLEAN, WORDS

CLV_NUM = ["c_acctbal", "n_orders", "mean_order", "churn"]
CLV_CAT = ["c_mktsegment"]


def clv_rows(t):
    """Customers with behaviour columns, their total spend as label and a repeatable test mark."""
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_order"))
    rows = (
        t.customer.join(per, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
        .join(spend(t), F.col("c_custkey") == F.col("o_custkey"))
        .select("c_custkey", "c_acctbal", "c_mktsegment", "n_orders", "mean_order", "churn", F.col("clv").alias("label"))
    )
    return sampling.random_split(rows, "c_custkey", 0.2, 42)


def parts(df):
    return df.where("is_test = 0"), df.where("is_test = 1")


@query("linreg_one_feature", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem
""")
def linreg_one_feature(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("label"), "l_quantity")
    fitted = Pipeline(stages=[*E.preprocess_stages(["l_quantity"], scale=False), E.linear_regression()]).fit(rows)
    line = fitted.stages[-1]
    return t.spark.range(1).select(F.round(F.lit(float(line.coefficients[0])), 4).alias("slope"),
                                   F.round(F.lit(float(line.intercept)), 3).alias("intercept"))


@query("clv_models")
def clv_models(t):
    train, test = parts(clv_rows(t))
    pre = Pipeline(stages=E.preprocess_stages(CLV_NUM, CLV_CAT)).fit(train)
    train, test = pre.transform(train), pre.transform(test)
    estimators = {
        "Boosted trees": E.boosted_regressor(), "Linear regression": E.linear_regression(),
        "Random forest": E.random_forest_regressor()}
    with cached(train):
        models = {name: est.fit(train) for name, est in estimators.items()}
    return metrics.compare_models({
        name: metrics.regression_metrics(m.transform(test), "label", "prediction") for name, m in models.items()})


@query("grid_search")
def grid_search(t):
    rows = sampling.kfold(clv_rows(t).where("is_test = 0"), "c_custkey", 3, 42)
    est = E.gbt_regressor(rounds=5, depth=3)
    search = E.grid_search(E.preprocess_stages(CLV_NUM, CLV_CAT), est,
                           {"maxIter": [2, 4], "maxDepth": [2, 4], "stepSize": [0.05, 0.1]}, "fold")
    with cached(rows):
        return E.grid_results(search.fit(rows), t.spark)


# ---------------------------------------------------------------- fraud models on orders

FRAUD_NUM = ["o_totalprice", "user_mean_order", "user_order_count", "user_device_changes", "order_value_deviation", "order_weekday"]


FRAUD_SQL = f"""
WITH f AS (SELECT o_orderkey, ((o_totalprice > 250000 OR o_totalprice > 150000 AND isodow(o_orderdate) >= 6)
                               <> ({hash_sql('o_orderkey', 'noise')} < 85899346))::INT AS label FROM orders),
held AS (SELECT sum(q)::BIGINT AS n FROM (SELECT floor(0.2 * count(*) + 0.5) AS q FROM f GROUP BY label))
"""


def fraud_label():
    """Dear orders, less dear ones at weekends, and two percent of noise."""
    rule = (F.col("o_totalprice") > 250000) | ((F.col("o_totalprice") > 150000) & (weekday_of("o_orderdate") >= 5))
    return (rule != (hash_int("o_orderkey", seed="noise") < 85899346)).cast("int")


def fraud_rows(t):
    """Orders with behavioural features and a label that follows from some of them."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", device_changes().alias("devices"),
                           fraud_label().alias("label"))
    # Split first: the draw needs only key and label, so its passes read two columns of the orders.
    rows = sampling.stratified_split(rows, "o_orderkey", "label", 0.2, 42)
    rows = profile.attach_group_stats(rows, "o_custkey", "o_totalprice", "devices")
    return rows.withColumns({"order_value_deviation": relative_deviation("o_totalprice", "user_mean_order"),
                             "order_weekday": weekday_of("o_orderdate")})


def fitted_fraud(t, *estimators):
    train, test = parts(fraud_rows(t))
    train = prepare.attach_class_weights(train, "label")
    pre = Pipeline(stages=E.preprocess_stages(FRAUD_NUM)).fit(train)
    ready, test = pre.transform(train), pre.transform(test)
    with cached(ready):
        return [est(ready).fit(ready) for est in estimators], ready, test


@query("fraud_models", FRAUD_SQL + """
SELECT model, n, true AS auc_holds, true AS f1_holds FROM held, (VALUES ('Logistic regression'), ('Random forest'), ('Boosted trees')) m(model)
""")
def fraud_models(t):
    """Held-out rows per model, and whether AUC and F1 reach what the label's noise allows (a linear model less)."""
    fitted, _, test = fitted_fraud(
        t, lambda d: E.logistic_regression(d.count()), lambda d: E.random_forest_classifier(weight="weight"),
        lambda d: E.gbt_classifier(weight="weight"))
    names = ["Logistic regression", "Random forest", "Boosted trees"]
    table = metrics.compare_models({n: E.classifier_metrics(E.score(m, test)) for n, m in zip(names, fitted)})
    tree = F.col("model") != "Logistic regression"
    return table.select("model", "n", (F.col("auc") > F.when(tree, 0.93).otherwise(0.85)).alias("auc_holds"),
                        (F.col("f1") > F.when(tree, 0.85).otherwise(0.7)).alias("f1_holds"))


CLEAR_SQL = """
SELECT o_orderkey, CASE WHEN o_totalprice > 270000 THEN 1 WHEN o_totalprice < 140000 THEN 0 ELSE (isodow(o_orderdate) >= 6)::INT END AS flag
FROM orders WHERE o_totalprice > 270000 OR o_totalprice < 140000 OR o_totalprice BETWEEN 165000 AND 235000
"""


@query("boosted_fraud", CLEAR_SQL)
def boosted_fraud(t):
    """Flags of the second-order boosted model for all orders that the label's rule decides clearly. Two percent of the labels
    it learns from are wrong, so the flags only equal the rule's if the model has found the rule and nothing else."""
    rows = fraud_rows(t)
    model = boosting.fit_boosted(rows.where("is_test = 0"), FRAUD_NUM, settings=boosting.Settings(
        rounds=150, depth=5, rate=0.1, ridge=10.0, least_weight=20.0))
    price = F.col("o_totalprice")
    clear = rows.where((price > 270000) | (price < 140000) | price.between(165000, 235000))
    return clear.select("o_orderkey", (model.predict() >= 0.5).cast("int").alias("flag"))


@query("open_forest", f"SELECT * FROM ({CLEAR_SQL}) c WHERE o_orderkey % 5 = 0")
def open_forest(t):
    """Flags of 200 trees of open depth for held-out orders that the label's rule decides clearly. The trees fit the wrong
    labels, too; their majority does not."""
    rows = fraud_rows(t)
    fitted = forest.fit_forest(rows.where("o_orderkey % 5 <> 0"), FRAUD_NUM, trees=200)
    price = F.col("o_totalprice")
    clear = rows.where("o_orderkey % 5 = 0").where((price > 270000) | (price < 140000) | price.between(165000, 235000))
    return fitted.predict(clear).select("o_orderkey", (F.col("p") >= 0.5).cast("int").alias("flag"))


@query("smote_logistic")
def smote_logistic(t):
    """Balance the training rows, then fit; the held-out rows stay as they are."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double"), lines.cast("double").alias("n_lines"))
    train, test = parts(sampling.stratified_split(rows, "doc_id", "label", 0.25, 25))
    with cached(train):
        even = neighbours.smote(train, "doc_id", "label", ["n_chars", "n_lines"], minority=0, k=5, seed=30)
        with cached(even):
            model = Pipeline(stages=[
                *E.preprocess_stages(["n_chars", "n_lines"]), E.logistic_regression(even.count())]).fit(even)
    return E.classifier_metrics(E.score(model, test))


def clear_label():
    """The label's rule for orders far from its limits; NULL for the others."""
    price = F.col("o_totalprice")
    return F.when(price > 270000, 1).when(price < 140000, 0).when(price.between(165000, 235000), (weekday_of("o_orderdate") >= 5).cast("int"))


@query("score_applicants", f"""
SELECT o_orderkey, model, true AS bucket_fits,
       CASE WHEN odd THEN NULL WHEN o_totalprice > 300000 THEN 'Yes' WHEN o_totalprice < 100000 THEN 'No' END AS predicted_default
FROM (SELECT *, {hash_sql('o_orderkey', 'noise')} < 85899346 AS odd FROM orders), (VALUES ('Linear Regression'), ('Random Forest')) m(model)
""")
def score_applicants(t):
    """Every order under both models. The bucket has to follow from the probability, and the answer for very dear and very
    cheap orders from the label's rule. Not shown are the answers on the others, which SQL cannot tell, and on the two
    percent with wrong labels, which a forest may learn by heart."""
    rows = fraud_rows(t)
    train, _ = parts(rows)
    stages = E.preprocess_stages(FRAUD_NUM)
    with cached(train):
        models = {
            "Linear Regression": Pipeline(stages=[*stages, E.linear_regression()]).fit(train),
            "Random Forest": Pipeline(stages=[*stages, E.random_forest_classifier()]).fit(train)}
    price = F.col("o_totalprice")
    shown = ((price > 300000) & (F.col("label") == 1)) | ((price < 100000) & (F.col("label") == 0))
    scored = E.score_applicants(rows.withColumn("shown", shown), models, "o_orderkey", keep=["shown"])
    p = F.col("default_probability")
    low, high = (F.col("risk_bucket") == b for b in ("Accept", "Reject"))
    # Probabilities are rounded to three digits, buckets come from the unrounded ones.
    fits = p.between(0, 1) & ((p < 0.3) <= low) & (low <= (p <= 0.3005)) & ((p > 0.6005) <= high) & (high <= (p >= 0.6))
    return scored.select("o_orderkey", "model", fits.alias("bucket_fits"),
                         F.when(F.col("shown"), F.col("predicted_default")).alias("predicted_default"))


@query("score_orders", """
SELECT o_orderkey, true AS flag_follows, true AS iso_follows, true AS rule_found FROM orders
""")
def score_orders(t):
    """Scoring run: model, scaler and isolation forest are saved, loaded, applied to every order, and the result is
    written as CSV and read back. Flags have to follow from the scores, and at least 98 of 100 flags of orders far from the
    label's limits have to be what its rule says (two of 100 labels are noise)."""
    rows = fraud_rows(t).withColumn("rule", clear_label())
    train, _ = parts(rows)
    scaled = [f"{c}_z" for c in FRAUD_NUM]
    place = f"{shared_dir(t.spark)}/scoring-{uuid.uuid4().hex}"
    with cached(train):
        model = Pipeline(stages=[*E.preprocess_stages(FRAUD_NUM), E.gbt_classifier()]).fit(train)
        forest = isolation.fit_isolation_forest(model.transform(train).select("o_orderkey", *scaled), "o_orderkey", scaled, trees=200)
    store.save_model(model, f"{place}/model")
    forest.save(f"{place}/forest")
    model, forest = store.load_model(f"{place}/model"), isolation.IsolationForestModel.load(t.spark, f"{place}/forest")
    ready = model.stages[0].transform(rows)
    scored = store.score_batch(ready, PipelineModel(stages=model.stages[1:]), forest)
    scored = scored.select("o_orderkey", "rule", "proba", "flag", "iso_score", "iso_flag")
    files.write_csv(scored, f"{place}/scores")
    back = files.read_csv(t.spark, f"{place}/scores", scored.schema)
    told = back.agg((F.avg((F.col("flag") == F.col("rule")).cast("double")) >= 0.98).alias("found"))
    return back.select("o_orderkey", (F.col("proba").between(0, 1) & ((F.col("proba") >= 0.5) == (F.col("flag") == 1))).alias("flag_follows"),
                       (F.col("iso_score").between(0, 1) & ((F.col("iso_score") > 0.5) == (F.col("iso_flag") == 1))).alias("iso_follows"),
                       profile.one_row(told)["found"].alias("rule_found"))


@query("model_reload", FRAUD_SQL + "SELECT n, 0::BIGINT AS n_different FROM held")
def model_reload(t):
    """Save a fitted model, load it again and count the orders it scores differently (none)."""
    train, test = parts(fraud_rows(t))
    model = Pipeline(stages=[*E.preprocess_stages(FRAUD_NUM), E.linear_regression()]).fit(train)
    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    store.save_model(model, path)
    return store.compare_scores(model, store.load_model(path), test)


ODD_SQL = hash_sql("o_orderkey", "odd") + " < 8589934"  # one order in 500


@query("isolation_forest", f"""
SELECT o_orderkey, {ODD_SQL} AS planted, CASE WHEN {ODD_SQL} THEN 1 END AS iso_flag, true AS others_rare FROM orders
""")
def isolation_forest(t):
    """Every order, with the flags of planted odd ones, which are far out in three features: all have to be flagged, and at
    most one in ten of the others, whose own flags SQL cannot tell."""
    rows = fraud_rows(t).withColumn("planted", hash_int("o_orderkey", seed="odd") < 8589934)
    for name, far in (("o_totalprice", 2e6), ("order_value_deviation", 30.0), ("user_device_changes", 40)):
        rows = rows.withColumn(name, F.when(F.col("planted"), F.lit(far)).otherwise(F.col(name).cast("double")))
    scaled = prepare.standard_scale(rows, FRAUD_NUM)
    fitted = isolation.fit_isolation_forest(scaled, "o_orderkey", FRAUD_NUM, trees=200)
    flagged = fitted.flag(scaled)
    rare = flagged.where("NOT planted").agg((F.avg("iso_flag") <= 0.1).alias("rare"))
    return flagged.select("o_orderkey", "planted", F.when(F.col("planted"), F.col("iso_flag")).alias("iso_flag"),
                          profile.one_row(rare)["rare"].alias("others_rare"))


@query("importance", "SELECT 6::BIGINT AS n, 1.0::DOUBLE AS total, 'o_totalprice' AS first")
def importance(t):
    """Number and sum of the importances, and the most important feature, which the label's rule names."""
    (forest,), ready, _ = fitted_fraud(t, lambda d: E.random_forest_classifier())
    table = explain.feature_importance(t.spark, forest, E.feature_names(ready))
    name, value = table.columns
    return table.agg(F.count("*").alias("n"), F.round(F.sum(value), 9).alias("total"), F.regexp_replace(F.max_by(name, value), "_z$", "").alias("first"))


@query("coefficients")
def coefficients(t):
    train, _ = parts(clv_rows(t))
    ready = Pipeline(stages=E.preprocess_stages(CLV_NUM, CLV_CAT)).fit(train).transform(train)
    return explain.coefficients(t.spark, E.linear_regression().fit(ready), E.feature_names(ready))


@query("top_coefficients", """
WITH c AS (SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS coefficient FROM lineitem
           UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
           UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)
SELECT feature, round(coefficient, 6) AS coefficient FROM c ORDER BY abs(coefficient) DESC, feature LIMIT 2
""")
def top_coefficients(t):
    """One-feature coefficients on standardised columns, the strongest two."""
    names = ["l_quantity", "l_discount", "l_tax"]
    table = profile.correlation_matrix(t.lineitem, [*names, "l_extendedprice"]).where(
        (F.col("b") == "l_extendedprice") & F.col("a").isin(names)).select(F.col("a").alias("feature"), F.col("corr").alias("coefficient"))
    return rounded(ordering.top_k_by_abs(table, "coefficient", "feature", 2))


@query("linear_shap", """
SELECT l_orderkey, l_linenumber, round(2.5 * (l_quantity - mq), 6) AS phi_l_quantity, round(-40.0 * (l_discount - md), 6) AS phi_l_discount
FROM lineitem, (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem) b
""")
def linear_shap(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = explain.linear_attribution(rows, {"l_quantity": 2.5, "l_discount": -40.0})
    return rounded(out.drop("l_quantity", "l_discount"))


@query("tree_shap")
def tree_shap(t):
    (forest,), ready, test = fitted_fraud(t, lambda d: E.random_forest_classifier())
    return explain.attribution_summary(
        explain.forest_attribution(forest, test, "o_orderkey", E.feature_names(ready)), E.feature_names(ready))


# ---------------------------------------------------------------- sequences and text

@query("late_payment_model")
def late_payment_model(t):
    flat = seq_plans.windows(t).select("o_orderkey", "o_custkey", "label", S.flatten_steps("seq", seq_plans.FIELDS).alias("x"))
    slots = [f"x{i}" for i in range(18)]
    rows = flat.select("o_orderkey", "o_custkey", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(slots)])
    rows = sampling.group_split(rows, "o_custkey")
    train = rows.where("part <> 'test'").withColumn("is_val", F.col("part") == "val")
    with cached(train):
        model = Pipeline(stages=[*E.preprocess_stages(slots, scale=False),
                                 E.gbt_classifier(rounds=15, depth=4, validation="is_val")]).fit(train)
    return E.classifier_metrics(E.score(model, rows.where("part = 'test'")))


@query("intent_model")
def intent_model(t):
    """Message text to the speaker's role, as a stand-in for intents."""
    rows = E.with_words(t.conversations, "text").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    train, test = parts(sampling.random_split(rows, "key", 0.2, 42))
    with cached(train):
        model = Pipeline(stages=E.intent_stages("role", train.count())).fit(train)
    scored = model.transform(test)
    return metrics.classification_report(scored, "label", "prediction")


@query("embed_text", f"SELECT doc_id, (len({WORDS.format(x=CLEAN)}) > 0)::INT::DOUBLE AS length FROM documents")
def embed_text(t):
    model = E.fit_embedder(t.documents, "text", dim=64)
    vectors = E.embed_text(model, t.documents.select("doc_id", "text"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select("doc_id", F.round(F.sqrt(square), 6).alias("length"))


@query("latent_retrieval")
def latent_retrieval(t):
    """The three documents nearest to every benchmark passage, by embeddings learnt from all documents."""
    model = latent.fit_latent(t.documents, "text", dim=32)
    # The search reads its sides several times, so each text is embedded once and written.
    asked = materialize(t.benchmark.select(F.col("item_id").alias("query_id"), model.embed("text").alias("embedding")))
    held = materialize(t.documents.select(F.col("doc_id").alias("id"), model.embed("text").alias("embedding")))
    return rounded(neighbours.nearest(asked, held, 3))


@query("grounded_questions")
def grounded_questions(t):
    """Benchmark passages asked of the documents: embed both, fetch the nearest text, build the prompt."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    model = E.fit_embedder(docs, "text", dim=64)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answers.context_prompt(E.embed_text(model, asked, "question"), E.embed_text(model, docs, "text"), 1).select(
        "query_id", "question", "prompt")
