"""Profiles and columns derived from whole-table statistics."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ordering, profile
from .registry import query

NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits=6, keep=()):
    return df.select(*[
        F.round(c, digits).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


@query("missing_profile", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_missing,
       round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS pct_missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""" for c in ("lang", "n_chars", "quality", "toxic")))
def missing_profile(t):
    docs = t.documents.join(t.labels, "doc_id", "left")
    return rounded(profile.missing_profile(docs, ["lang", "n_chars", "quality", "toxic"]))


@query("describe", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in NUMERICS))
def describe(t):
    return rounded(profile.describe(t.lineitem, NUMERICS))


@query("histogram20", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
x AS (SELECT LEAST(floor((value - lo) / ((hi - lo) / 20))::INT + 1, 20) AS bin FROM events, b)
SELECT bin, count(*) AS n FROM x GROUP BY bin
""")
def histogram20(t):
    return profile.histogram(t.events, "value", 20)


@query("box_stats", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       min(value) FILTER (value >= lo) AS whisker_low, max(value) FILTER (value <= hi) AS whisker_high,
       count(*) FILTER (value < lo OR value > hi) AS n_outliers FROM events, f
""")
def box_stats(t):
    return rounded(profile.box_stats(t.events, "value"))


CORR_COLS = [*NUMERICS, "returned"]


@query("corr_matrix", "WITH r AS (SELECT *, (l_returnflag = 'R')::INT AS returned FROM lineitem)" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM r" for a in CORR_COLS for b in CORR_COLS))
def corr_matrix(t):
    rows = t.lineitem.select(*NUMERICS, (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return rounded(profile.correlation_matrix(rows, CORR_COLS))


@query("minmax", """
SELECT event_id, round((value - lo) / (hi - lo + 1e-9), 6) AS scaled
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) b
""")
def minmax(t):
    return rounded(profile.minmax_normalize(t.events.select("event_id", "value"), "value", "scaled").drop("value"))


SPEND_SQL = """
WITH last AS (SELECT max(o_orderdate) AS last_day FROM orders),
c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS clv, max(o_orderdate) AS recent FROM orders GROUP BY o_custkey),
s AS (SELECT o_custkey, clv, LEAST(GREATEST(date_diff('day', recent, last_day) / 1000.0::DOUBLE, 0), 1) AS churn FROM c, last)
"""


def spend(t):
    """Customer value and churn stand-ins: total spend, and days since the last order."""
    orders = t.orders.select("o_custkey", "o_totalprice", "o_orderdate")
    last_day = orders.agg(F.max("o_orderdate").alias("m")).scalar()
    per = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("clv"), F.max("o_orderdate").alias("recent"))
    churn = C.clip(F.date_diff(last_day, F.col("recent")) / F.lit(1000.0), 0.0, 1.0)
    return per.select("o_custkey", "clv", churn.alias("churn"))


TIER_SQL = SPEND_SQL + """,
q AS (SELECT quantile_cont(clv, 0.5) AS q50, quantile_cont(clv, 0.8) AS q80 FROM s),
tiers AS (SELECT o_custkey, clv, churn, CASE WHEN clv <= q50 THEN 'Low' WHEN clv <= q80 THEN 'Medium' ELSE 'High' END AS tier FROM s, q)
"""


@query("quantile_tiers", TIER_SQL + "SELECT o_custkey, clv, tier FROM tiers")
def quantile_tiers(t):
    return profile.quantile_tiers(spend(t).select("o_custkey", "clv"), "clv")


@query("recommend_action", TIER_SQL + """
SELECT o_custkey, tier, churn, CASE WHEN tier = 'High' AND churn > 0.5 THEN 'Retention Priority'
       WHEN tier IN ('High', 'Medium') THEN 'Upsell/Cross-sell' ELSE 'Low-cost Nurture' END AS action FROM tiers
""")
def recommend_action(t):
    tiers = profile.quantile_tiers(spend(t), "clv")
    return tiers.select("o_custkey", "tier", "churn", C.recommend_action("tier", "churn").alias("action"))


@query("top_customers", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS clv FROM orders GROUP BY o_custkey ORDER BY clv DESC, o_custkey LIMIT 10
""")
def top_customers(t):
    return ordering.top_k(spend(t).select("o_custkey", "clv"), 10, F.desc("clv"), F.asc("o_custkey"))
