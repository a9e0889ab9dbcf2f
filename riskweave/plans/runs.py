"""Whole runs: fit, score, then tiers and actions, or metrics and flags per group."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..models import boosting, isolation, runs
from ..models import estimators as E
from ..operators import prepare
from ..session import cached
from .learning import FRAUD_NUM, clear_label, clv_rows, fraud_rows, parts
from .profiling import SPEND_SQL
from .registry import hash_sql, query


# Least squares on two columns in closed form, from the moments of the training rows.
@query("predicted_tiers", SPEND_SQL + f""",
p AS (SELECT o_custkey, count(*)::DOUBLE AS x, avg(o_totalprice) AS z FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey, x, z, clv, churn, {hash_sql('c_custkey', 42)} < 858993459 AS is_test
      FROM customer JOIN p ON c_custkey = p.o_custkey JOIN s ON c_custkey = s.o_custkey),
m AS (SELECT var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, clv) AS xy, covar_pop(z, clv) AS zy,
             avg(x) AS mx, avg(z) AS mz, avg(clv) AS my FROM r WHERE NOT is_test),
f AS (SELECT c_custkey, churn, my + (xy * zz - zy * xz) / (xx * zz - xz * xz) * (x - mx) + (zy * xx - xy * xz) / (xx * zz - xz * xz) * (z - mz) AS v
      FROM r, m WHERE is_test),
q AS (SELECT quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.8) AS q80 FROM f),
t AS (SELECT c_custkey, churn, CASE WHEN v <= q50 THEN 'Low' WHEN v <= q80 THEN 'Medium' ELSE 'High' END AS tier FROM f, q)
SELECT c_custkey, churn, tier, CASE WHEN tier = 'High' AND churn > 0.5 THEN 'Retention Priority'
       WHEN tier IN ('High', 'Medium') THEN 'Upsell/Cross-sell' ELSE 'Low-cost Nurture' END AS action FROM t
""")
def predicted_tiers(t):
    """Value predicted for held-out customers by a model of the others, its tier, and what to do about the customer."""
    train, test = parts(clv_rows(t))
    with cached(train):
        model = Pipeline(stages=[*E.preprocess_stages(["n_orders", "mean_order"]), E.linear_regression()]).fit(train)
    return runs.value_actions(model, test, "churn").select("c_custkey", "churn", "tier", "action")


@query("order_fraud_run", f"""
WITH f AS (SELECT *, ((o_totalprice > 250000 OR o_totalprice > 150000 AND isodow(o_orderdate) >= 6)
                      <> ({hash_sql('o_orderkey', 'noise')} < 85899346))::INT AS label FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(o_orderkey || ':42')) AS rn, count(*) OVER (PARTITION BY label) AS n FROM f),
held AS (SELECT * FROM h JOIN customer ON o_custkey = c_custkey WHERE rn <= floor(0.2 * n + 0.5)),
c AS (SELECT c_mktsegment, o_orderpriority, CASE WHEN o_totalprice > 270000 THEN 1 WHEN o_totalprice < 140000 THEN 0
             ELSE (isodow(o_orderdate) >= 6)::INT END AS flag
      FROM held WHERE o_totalprice > 270000 OR o_totalprice < 140000 OR o_totalprice BETWEEN 165000 AND 235000)
SELECT 'c_mktsegment' AS part, c_mktsegment AS value, count(*) AS n, round(avg(flag), 6) AS rate, NULL::BOOLEAN AS holds FROM c GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(flag), 6), NULL FROM c GROUP BY ALL
UNION ALL SELECT 'model', m, (SELECT count(*) FROM held), NULL, true FROM (VALUES ('Boosted trees'), ('Isolation forest')) v(m)
""")
def order_fraud_run(t):
    """Boosted trees and isolation forest fitted on four fifths of the orders and measured on the rest; mean flag of the boosted
    model per segment and priority.

    The rates count the held-out orders far from the label's limits, whose flags SQL can tell. The boosted model has to reach what
    the noise of the labels allows; its lines and those of the forest, which knows no labels, have to count every order once."""
    rows = fraud_rows(t)
    train, test = parts(rows)
    model = boosting.fit_boosted(train, FRAUD_NUM, settings=boosting.Settings(
        rounds=150, depth=5, rate=0.1, ridge=10.0, least_weight=20.0))
    scaled = [f"{c}_z" for c in FRAUD_NUM]
    stats = prepare.scaler_stats(train, FRAUD_NUM)
    odd = isolation.fit_isolation_forest(
        prepare.apply_scaler(train, stats, FRAUD_NUM, "_z").select("o_orderkey", *scaled), "o_orderkey", scaled, trees=200)
    groups = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").drop("o_custkey")
    ready = prepare.apply_scaler(test, stats, FRAUD_NUM, "_z").join(groups, "o_orderkey")
    scored = odd.flag(ready.withColumns({"proba": model.predict(), "clear": clear_label()}))
    scored = scored.withColumn("flag", (F.col("proba") >= 0.5).cast("int"))

    table = runs.evaluate_flags(scored, {"Boosted trees": "proba", "Isolation forest": "iso_score"})
    counted = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("n")
    good = F.when(F.col("model") == "Boosted trees", (F.col("auc") > 0.93) & (F.col("f1") > 0.85)).otherwise(F.lit(True))
    measured = table.select(F.lit("model").alias("part"), F.col("model").alias("value"), "n", F.lit(None).cast("double").alias("rate"),
                            (counted & good).alias("holds"))
    rates = runs.flag_rates(scored.where("clear IS NOT NULL"), ["c_mktsegment", "o_orderpriority"], "flag")
    return rates.select("part", "value", "n", F.round("rate", 6).alias("rate"), F.lit(None).cast("boolean").alias("holds")).unionByName(measured)
