"""Per-key statistics, joins back to rows, and segment summaries."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile, sequences
from .columns import device_changes
from .registry import query

STATS_SQL = """
SELECT o_custkey, avg(o_totalprice) AS mean_order, count(*) AS n_orders,
       max(5 - substr(o_orderpriority, 1, 1)::INT) AS devices FROM orders GROUP BY o_custkey
"""


def order_rows(t):
    """Orders in the shape of the web-order features."""
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", device_changes().alias("devices"))


@query("user_stats", f"""
WITH s AS ({STATS_SQL}) SELECT o_custkey, round(mean_order, 6) AS mean_order, n_orders, devices FROM s
""")
def user_stats(t):
    s = profile.user_stats(order_rows(t), "o_custkey", "o_totalprice", "devices")
    return s.select("o_custkey", F.round("user_mean_order", 6).alias("mean_order"),
                    F.col("user_order_count").alias("n_orders"), F.col("user_device_changes").alias("devices"))


@query("attach_stats", f"""
WITH s AS ({STATS_SQL}) SELECT o_orderkey, o.o_custkey, round(mean_order, 6) AS mean_order, n_orders, s.devices
FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey
""")
def attach_stats(t):
    rows = profile.attach_group_stats(order_rows(t), "o_custkey", "o_totalprice", "devices")
    return rows.select("o_orderkey", "o_custkey", F.round("user_mean_order", 6).alias("mean_order"),
                       F.col("user_order_count").alias("n_orders"), F.col("user_device_changes").alias("devices"))


@query("order_deviation", f"""
WITH s AS ({STATS_SQL}) SELECT o_orderkey, round(abs(o_totalprice - mean_order) / (mean_order + 1e-6), 6) AS deviation
FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey
""")
def order_deviation(t):
    rows = profile.attach_group_stats(order_rows(t), "o_custkey", "o_totalprice")
    return rows.select("o_orderkey", F.round(C.relative_deviation("o_totalprice", "user_mean_order"), 6).alias("deviation"))


@query("velocity", """
WITH c AS (
  SELECT event_id, user_id,
         count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day,
         count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_hour
  FROM events)
SELECT event_id, user_id, n_day, n_hour, CASE WHEN n_day >= 3 OR n_hour >= 2 THEN 1 ELSE 0 END AS high_velocity FROM c
""")
def velocity(t):
    rows = sequences.velocity_counts(t.events.select("event_id", "user_id", "ts"), "user_id", "ts",
                                     {"n_day": 86_400, "n_hour": 3_600})
    return rows.select("event_id", "user_id", "n_day", "n_hour",
                       C.velocity_flag(F.col("n_day"), F.col("n_hour")).alias("high_velocity"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t):
    return profile.value_counts(t.events, "event_type")


@query("segment_risk", """
SELECT c_mktsegment, round(avg((5 - substr(o_orderpriority, 1, 1)::INT > 2)::INT), 6) AS risk, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def segment_risk(t):
    flagged = t.orders.select("o_custkey", C.threshold_flag(device_changes(), 2).alias("flag"))
    rows = flagged.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return profile.segment_risk(rows, "c_mktsegment", "flag").withColumn("risk", F.round("risk", 6))


@query("members_only", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def members_only(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return profile.members_only(t.orders, keys, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("positive_rate", "SELECT count(*) AS n, round(avg(quality), 6) AS positive_rate FROM labels")
def positive_rate(t):
    return profile.positive_rate(t.labels, "quality").withColumn("positive_rate", F.round("positive_rate", 6))


@query("distinct_keys", "SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(t):
    return profile.distinct_keys(t.orders, "o_custkey")


@query("distinct_counts", """
SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_distinct FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events
""")
def distinct_counts(t):
    return profile.distinct_counts(t.events, "user_id", "event_type")


# ---------------------------------------------------------------- the whole chain in one plan

@query("order_risk_by_segment", """
WITH s AS (SELECT o_custkey AS k, avg(o_totalprice) AS mean_order FROM orders GROUP BY o_custkey),
r AS (
  SELECT o_orderkey, o_custkey, o_totalprice, isodow(o_orderdate) - 1 AS weekday, mean_order,
         5 - substr(o_orderpriority, 1, 1)::INT AS devices,
         count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
                        RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day
  FROM orders LEFT JOIN s ON o_custkey = k),
w AS (
  SELECT o_custkey, GREATEST(2.0 * abs(o_totalprice - mean_order) / (mean_order + 1e-6)
         + 1.5 * (devices > 2)::INT + 1.0 * (n_day >= 3)::INT + 0.1 * weekday, 0) AS score FROM r),
z AS (SELECT o_custkey, (score - lo) / (hi - lo + 1e-9) AS p
      FROM w, (SELECT min(score) AS lo, max(score) AS hi FROM w) b)
SELECT c_mktsegment, count(*) AS n, round(avg((p >= 0.5)::INT), 6) AS risk,
       count(*) FILTER (p < 0.3) AS low, count(*) FILTER (p >= 0.3 AND p < 0.7) AS medium,
       count(*) FILTER (p >= 0.7) AS high
FROM z JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def order_risk_by_segment(t):
    # Counting first leaves the rows partitioned by customer, which the join below then reuses.
    rows = sequences.velocity_counts(order_rows(t), "o_custkey", "o_orderdate", {"n_day": 86_400})
    rows = profile.attach_group_stats(rows, "o_custkey", "o_totalprice", stats_from=order_rows(t)).select(
        "o_custkey", C.relative_deviation("o_totalprice", "user_mean_order").alias("deviation"),
        C.weekday_of("o_orderdate").alias("weekday"), C.threshold_flag("devices", 2).alias("high_device_change"),
        C.velocity_flag(F.col("n_day")).alias("high_velocity"))
    scored = rows.select("o_custkey", C.weighted_score(
        {"deviation": 2.0, "high_device_change": 1.5, "high_velocity": 1.0, "weekday": 0.1}).alias("score"))
    scored = profile.minmax_normalize(scored, "score", "p")
    scored = scored.select("o_custkey", C.decide("p").alias("flag"), C.risk_bucket(
        "p", [0.3, 0.7], ["Low Risk", "Medium Risk", "High Risk"]).alias("bucket"))
    joined = scored.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg("flag"), 6).alias("risk"),
        *[F.count_if(F.col("bucket") == f"{b} Risk").alias(b.lower()) for b in ("Low", "Medium", "High")],
    ).orderBy(F.desc("risk"), "c_mktsegment")
