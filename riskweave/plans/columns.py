"""Row-wise expressions on whole tables."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import profile
from .registry import query


@query("map_values", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END AS returned FROM lineitem
""")
def map_values(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.map_values("l_returnflag", {"R": 1, "N": 0}).alias("returned"))


@query("label_rule", """
WITH e AS (SELECT event_id, value, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN k // 20 > 3 OR k % 8 > 5 OR (event_type IN ('click', 'view') AND value / 10 < 0.5)
                      THEN 1 ELSE 0 END AS fraud_label FROM e
""")
def label_rule(t):
    k = F.get_json_object("props", "$.k").cast("int")
    plan = F.when(F.col("event_type").isin("click", "view"), "prepaid").otherwise("postpaid")
    return t.events.select(
        "event_id", C.swap_fraud_label(F.floor(k / 20), k % 8, plan, F.col("value") / 10).alias("fraud_label"))


@query("clip", """
SELECT c_custkey, LEAST(GREATEST(c_acctbal, 0), 5000) AS both_sides, GREATEST(c_acctbal, 0) AS one_side FROM customer
""")
def clip(t):
    return t.customer.select("c_custkey", C.clip("c_acctbal", 0.0, 5000.0).alias("both_sides"),
                             C.clip("c_acctbal", lo=0.0).alias("one_side"))


@query("safe_ratio", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_tax / l_discount END AS ratio_or_zero,
       l_tax / (l_discount + 1) AS ratio_plus_one FROM lineitem
""")
def safe_ratio(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", C.safe_ratio("l_tax", "l_discount").alias("ratio_or_zero"),
        C.safe_ratio("l_tax", "l_discount", "plus_one").alias("ratio_plus_one"))


@query("period_rate", """
SELECT l_orderkey, l_linenumber, l_quantity / 30.0::DOUBLE AS per_day, l_quantity / 4.0::DOUBLE AS per_week FROM lineitem
""")
def period_rate(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.period_rate("l_quantity", 30).alias("per_day"),
                             C.period_rate("l_quantity", 4).alias("per_week"))


# Labels exist for some documents only, so the left join leaves real gaps to fill.
@query("fill_zero", """
SELECT d.doc_id, d.n_chars, COALESCE(quality, 0) AS quality, COALESCE(toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def fill_zero(t):
    return profile.numeric_matrix(t.documents.join(t.labels, "doc_id", "left"))


@query("select_by_type", """
SELECT c_nationkey, c_acctbal, length(c_name) + length(c_mktsegment) AS text_chars FROM customer
""")
def select_by_type(t):
    customer = t.customer
    numeric = profile.columns_of_type(customer, "numeric", exclude=["c_custkey"])
    words = profile.columns_of_type(customer, "string")
    return customer.select(*numeric, sum((F.length(c) for c in words), F.lit(0)).cast("bigint").alias("text_chars"))


@query("filter_nonblank", r"""
SELECT conv_id, turn, text FROM conversations
WHERE role = 'user' AND regexp_matches(text, '[^\s\x0B\x1C-\x1F\x85\pZ]')
""")
def filter_nonblank(t):
    return t.conversations.where((F.col("role") == "user") & X.not_blank("text")).select("conv_id", "turn", "text")


@query("decide", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS class,
       CASE WHEN l_discount * 10 >= 0.5 THEN 'Yes' ELSE 'No' END AS answer, round(l_discount * 10, 3) AS p FROM lineitem
""")
def decide(t):
    p = F.col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", C.decide(p).alias("class"), C.yes_no(p).alias("answer"),
                             F.round(p, 3).alias("p"))


@query("calendar", """
SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday FROM events
""")
def calendar(t):
    return t.events.select("event_id", C.hour_of("ts").alias("hour"), C.weekday_of("ts").alias("weekday"))


@query("device_flag", """
SELECT o_orderkey, CASE WHEN 5 - substr(o_orderpriority, 1, 1)::INT > 2 THEN 1 ELSE 0 END AS high_device_change FROM orders
""")
def device_flag(t):
    return t.orders.select("o_orderkey", C.threshold_flag(device_changes(), 2).alias("high_device_change"))


def device_changes():
    """Stand-in for a device-change count: 0 to 4 from the order priority."""
    return F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")


BUCKET_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 {op} {a} THEN '{x}' WHEN l_discount * 10 {op} {b} THEN '{y}'
                                      ELSE '{z}' END AS bucket FROM lineitem
"""


@query("risk_bucket_left", BUCKET_SQL.format(op="<", a=0.3, b=0.7, x="Low Risk", y="Medium Risk", z="High Risk"))
def risk_bucket_left(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.risk_bucket(
        F.col("l_discount") * 10, [0.3, 0.7], ["Low Risk", "Medium Risk", "High Risk"], "left").alias("bucket"))


@query("risk_bucket_right", BUCKET_SQL.format(op="<=", a=0.3, b=0.6, x="Accept", y="Review", z="Reject"))
def risk_bucket_right(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.risk_bucket(
        F.col("l_discount") * 10, [0.3, 0.6], ["Accept", "Review", "Reject"], "right").alias("bucket"))


@query("weighted_score", """
SELECT c_custkey, round(GREATEST(0.002 * c_acctbal + 2 * c_nationkey + 50 * (c_mktsegment = 'MACHINERY')::INT
       + 30 * (c_mktsegment = 'FURNITURE')::INT - 0.001 * c_acctbal * c_nationkey, 0), 6) AS score FROM customer
""")
def weighted_score(t):
    return t.customer.select("c_custkey", F.round(C.weighted_score(
        {"c_acctbal": 0.002, "c_nationkey": 2.0},
        {("c_mktsegment", "MACHINERY"): 50.0, ("c_mktsegment", "FURNITURE"): 30.0},
        {("c_acctbal", "c_nationkey"): -0.001}), 6).alias("score"))
