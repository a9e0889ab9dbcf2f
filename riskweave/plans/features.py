"""Scaling, encoding, imputation and class weights on whole tables."""

from pyspark.sql import functions as F

from ..functions.columns import map_values
from ..operators import categories, prepare, profile, sampling
from ..sources import files
from .profiling import NUMERICS, rounded
from .registry import hash_sql, query


@query("order_features", """
WITH s AS (SELECT o_custkey AS k, avg(o_totalprice) AS m, count(*) AS c FROM orders GROUP BY o_custkey)
SELECT round(o_totalprice, 2) AS order_amount, round(m, 6) AS user_mean_order, c AS user_order_count,
       round(abs(o_totalprice - m) / (m + 1e-6), 6) AS order_value_deviation, hour(o_orderdate)::INT AS order_hour,
       (isodow(o_orderdate) - 1)::INT AS order_weekday, 0 AS high_device_change, 0 AS high_velocity,
       (c_mktsegment = 'BUILDING')::INT AS billing_region_BUILDING, (c_mktsegment = 'FURNITURE')::INT AS billing_region_FURNITURE,
       (c_mktsegment = 'HOUSEHOLD')::INT AS billing_region_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::INT AS billing_region_MACHINERY
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON o_custkey = k
""")
def order_features(t):
    """The order features from a table without device or velocity columns, as a numeric matrix."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("order_amount"), F.col("c_mktsegment").alias("billing_region"))
    return rounded(profile.numeric_matrix(prepare.order_fraud_features(rows), exclude=prepare.NOT_FEATURES))


@query("normalize_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def normalize_columns(t):
    shouting = t.customer.select(*[F.col(c).alias(c.upper()) for c in ("c_custkey", "c_name", "c_mktsegment")])
    return files.normalize_columns(shouting)


@query("standard_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUMERICS) + " FROM lineitem, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERICS) + " FROM lineitem) b")
def standard_scale(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *NUMERICS)
    return rounded(prepare.standard_scale(rows, NUMERICS))


@query("scale_from_train", f"""
WITH m AS (SELECT event_id, value, {hash_sql('event_id', 42)} < 858993459 AS is_test FROM events),
b AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM m WHERE NOT is_test)
SELECT event_id, round((value - mu) / sd, 6) AS value FROM m, b WHERE is_test
""")
def scale_from_train(t):
    rows = sampling.random_split(t.events.select("event_id", "value"), "event_id", 0.2, 42)
    stats = prepare.scaler_stats(rows.where("is_test = 0"), ["value"])
    return rounded(prepare.apply_scaler(rows.where("is_test = 1").drop("is_test"), stats, ["value"]))


# Fitted on the documents that carry a label; sources seen only elsewhere give all zeros.
@query("one_hot_ignore", """
SELECT doc_id, (lang = 'de')::INT AS lang_de, (lang = 'en')::INT AS lang_en, (lang = 'es')::INT AS lang_es,
       (lang = 'fr')::INT AS lang_fr FROM documents
""")
def one_hot_ignore(t):
    docs = t.documents.select("doc_id", "lang")
    labelled = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return prepare.one_hot_ignore(docs, "lang", fit_on=labelled).drop("lang")


@query("dummies_drop_first", """
SELECT o_orderkey, (o_orderpriority = '2-HIGH')::INT AS "o_orderpriority_2-HIGH",
       (o_orderpriority = '3-MEDIUM')::INT AS "o_orderpriority_3-MEDIUM",
       (o_orderpriority = '4-NOT SPECIFIED')::INT AS "o_orderpriority_4-NOT SPECIFIED",
       (o_orderpriority = '5-LOW')::INT AS "o_orderpriority_5-LOW" FROM orders
""")
def dummies_drop_first(t):
    return prepare.dummies_drop_first(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


# Fitted without the first line of every order, so orders of a single line are never seen.
@query("sparse_categories", """
WITH f AS (SELECT l_orderkey::VARCHAR AS o, l_returnflag AS m FROM lineitem WHERE l_linenumber > 1),
o AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS slot FROM (SELECT DISTINCT o FROM f)),
m AS (SELECT m, row_number() OVER (ORDER BY m) - 1 + (SELECT count(*) FROM o) AS slot FROM (SELECT DISTINCT m FROM f))
SELECT l_orderkey, l_linenumber, ((SELECT count(*) FROM o) + (SELECT count(*) FROM m))::INT AS size,
       concat_ws(',', o.slot + 1, m.slot + 1) AS indices, round(l_quantity, 6) AS first
FROM lineitem LEFT JOIN o ON l_orderkey::VARCHAR = o.o LEFT JOIN m ON l_returnflag = m.m
""")
def sparse_categories(t):
    """One sparse vector per line: the quantity, its order (as many categories as orders) and its return flag."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    cols = ["l_orderkey", "l_returnflag"]
    known = categories.fit_categories(rows.where("l_linenumber > 1"), cols)
    v = categories.encode_categories(rows, known, cols, "v", numeric=["l_quantity"])
    slots = F.filter("v.indices", lambda i: i > 0)
    return v.select("l_orderkey", "l_linenumber", (F.col("v.size") - 1).alias("size"), F.array_join(slots.cast("array<string>"), ",").alias("indices"),
                    F.round(F.col("v.values")[0], 6).alias("first"))


@query("label_encode", """
SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM customer
""")
def label_encode(t):
    return prepare.label_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


@query("category_codes", """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events),
k AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT kind FROM e WHERE kind IS NOT NULL))
SELECT event_id, COALESCE(code, -1)::BIGINT AS code FROM e LEFT JOIN k ON e.kind = k.kind
""")
def category_codes(t):
    # An error event has no kind of its own: it stands for the missing category.
    rows = t.events.select("event_id", map_values(
        "event_type", {k: k for k in ("click", "purchase", "signup", "view")}).alias("kind"))
    return prepare.category_codes(rows, "kind", "code").select("event_id", "code")


# Zero discounts and error events stand for values that were never recorded.
@query("impute", """
WITH e AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_returnflag, 'N') AS flag FROM lineitem),
m AS (SELECT median(discount) AS d FROM e),
f AS (SELECT flag FROM e WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
SELECT l_orderkey, l_linenumber, COALESCE(discount, (SELECT d FROM m)) AS discount, COALESCE(flag, (SELECT flag FROM f)) AS flag FROM e
""")
def impute(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return prepare.impute(rows, ["discount"], ["flag"])


@query("winsorize", """
SELECT event_id, round(CASE WHEN value > q THEN q ELSE value END, 6) AS value
FROM events, (SELECT quantile_cont(value, 0.99) AS q FROM events) b
""")
def winsorize(t):
    return rounded(prepare.winsorize(t.events.select("event_id", "value"), ["value"], 0.99))


@query("class_weights", """
SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality
""")
def class_weights(t):
    return rounded(prepare.class_weights(t.labels, "quality"))


@query("pos_weight", """
SELECT count(*) FILTER (toxic = 0) AS negatives, count(*) FILTER (toxic = 1) AS positives,
       round(count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1), 6) AS pos_weight FROM labels
""")
def pos_weight(t):
    return rounded(prepare.pos_weight(t.labels, "toxic"))
