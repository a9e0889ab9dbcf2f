"""Six-step behaviour sequences per customer with the next step as label.

Stand-ins on orders: on time unless the status is 'P'; spend ratio and late days from price and weekday.
"""

from pyspark.sql import functions as F

from ..functions.columns import weekday_of
from ..operators import sequences as S
from .registry import query

FIELDS = ["on_time", "spend_ratio", "late_days"]

STEPS_SQL = """
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, (o_orderstatus <> 'P')::INT AS on_time,
                  floor(o_totalprice / 250000)::INT AS spend_ratio, (isodow(o_orderdate) - 1)::INT AS late_days FROM orders),
w AS (SELECT *, list({'a': on_time, 'b': spend_ratio, 'c': late_days}) OVER (
                  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS seq FROM s),
q AS (SELECT o_orderkey, o_custkey, 1 - on_time AS label, seq FROM w WHERE len(seq) = 6)
"""


def steps(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") != "P").cast("int").alias("on_time"),
        F.floor(F.col("o_totalprice") / 250000).cast("int").alias("spend_ratio"), weekday_of("o_orderdate").alias("late_days"))


def windows(t):
    rows = S.sliding_sequences(
        steps(t), "o_custkey", ["o_orderdate", "o_orderkey"], {f: F.col(f) for f in FIELDS}, 6)
    return rows.select("o_orderkey", "o_custkey", S.next_step_label(F.col("on_time")).alias("label"), "seq")


def step_text(seq):
    return F.array_join(F.transform(seq, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in FIELDS])), "|")


TEXT_SQL = "array_to_string(list_transform({seq}, lambda z: z.a || ':' || z.b || ':' || z.c), '|')"


@query("sliding_sequences", STEPS_SQL + f"SELECT o_orderkey, o_custkey, label, {TEXT_SQL.format(seq='seq')} AS seq FROM q")
def sliding_sequences(t):
    return windows(t).withColumn("seq", step_text(F.col("seq")))


@query("sequence_mask", STEPS_SQL + f""",
m AS (SELECT o_orderkey, list_filter(seq, lambda z: NOT (z.a = 0 AND z.b = 0 AND z.c = 0)) AS live FROM q)
SELECT o_orderkey, len(live)::INT AS n_live, COALESCE({TEXT_SQL.format(seq='live')}, '') AS seq FROM m
""")
def sequence_mask(t):
    live = windows(t).select("o_orderkey", S.mask_steps("seq", FIELDS).alias("live"))
    return live.select("o_orderkey", F.size("live").alias("n_live"), step_text(F.col("live")).alias("seq"))


@query("flatten_sequence", STEPS_SQL + """,
f AS (SELECT o_orderkey, label, flatten(list_transform(seq, lambda z: [z.a::DOUBLE, z.b::DOUBLE, z.c / 10.0::DOUBLE])) AS x FROM q)
SELECT o_orderkey, label, unnest(range(18))::INT AS slot, unnest(x) AS value FROM f
""")
def flatten_sequence(t):
    scaled = windows(t).withColumn("seq", F.transform("seq", lambda s: F.struct(
        s["on_time"].alias("on_time"), s["spend_ratio"].alias("spend_ratio"), (s["late_days"] / F.lit(10.0)).alias("late_days"))))
    flat = scaled.select("o_orderkey", "label", S.flatten_steps("seq", FIELDS).alias("x"))
    return flat.select("o_orderkey", "label", F.posexplode("x").alias("slot", "value"))


@query("min_history", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 7)
""")
def min_history(t):
    return S.min_history(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 7)
