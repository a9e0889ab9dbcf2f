"""Batch scoring of vectors with fixed layer weights, and class probabilities."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import query

INPUTS, HIDDEN, CLASSES = 64, 4, 10


def weight(i: int, j: int, shift: int) -> float:
    """Fixed demonstration weights from a rule both sides can state."""
    return ((i * 7 + j * 3 + shift) % 11 - 5) / 5.0


def matrix(rows: int, cols: int, shift: int) -> list[list[float]]:
    return [[weight(i, j, shift) for j in range(cols)] for i in range(rows)]


def bias(cols: int, shift: int) -> list[float]:
    return [weight(0, j, shift) for j in range(cols)]


def layer_sql(source: str, rows: int, cols: int, shift: int, act: str) -> str:
    z = (f"list_sum(list_transform(range({rows}), lambda i: x[i + 1] * (((i * 7 + j * 3 + {shift}) % 11) - 5) / 5.0::DOUBLE))"
         f" + (((j * 3 + {shift}) % 11) - 5) / 5.0::DOUBLE")
    return f"SELECT id, label, list_transform(range({cols}), lambda j: {act.format(z=z)}) AS x FROM {source}"


SIGMOID, RELU, TANH, PLAIN = "1 / (1 + exp(-({z})))", "GREATEST({z}, 0)", "tanh({z})", "{z}"
SOFTMAX = """e{n} AS (SELECT id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS x FROM {src}),
p{n} AS (SELECT id, label, list_transform(x, lambda v: v / list_sum(x)) AS x FROM e{n})"""
INPUT_SQL = "WITH x0 AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings)"

PROBS_SQL = f"""{INPUT_SQL},
h AS ({layer_sql('x0', INPUTS, HIDDEN, 1, SIGMOID)}),
z AS ({layer_sql('h', HIDDEN, CLASSES, 2, PLAIN)}),
{SOFTMAX.format(n='', src='z')}
"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")


def probabilities(t):
    p = A.layers("embedding", [
        (matrix(INPUTS, HIDDEN, 1), bias(HIDDEN, 1), A.sigmoid), (matrix(HIDDEN, CLASSES, 2), bias(CLASSES, 2), A.softmax)])
    return vectors(t).select("id", "label", p.alias("p"))


@query("mlp_forward", f"""{INPUT_SQL},
h AS ({layer_sql('x0', INPUTS, HIDDEN, 1, SIGMOID)}),
o AS ({layer_sql('h', HIDDEN, 1, 3, SIGMOID)})
SELECT id, round(x[1], 6) AS p FROM o
""")
def mlp_forward(t):
    p = A.layers("embedding", [
        (matrix(INPUTS, HIDDEN, 1), bias(HIDDEN, 1), A.sigmoid), (matrix(HIDDEN, 1, 3), bias(1, 3), A.sigmoid)])
    return vectors(t).select("id", F.round(p[0], 6).alias("p"))


@query("mlp_three_layers", f"""{INPUT_SQL},
h AS ({layer_sql('x0', INPUTS, 5, 4, RELU)}),
g AS ({layer_sql('h', 5, 4, 5, TANH)}),
z AS ({layer_sql('g', 4, 2, 6, PLAIN)}),
{SOFTMAX.format(n='', src='z')}
SELECT id, round(x[1], 6) AS p0, round(x[2], 6) AS p1 FROM p
""")
def mlp_three_layers(t):
    p = A.layers("embedding", [
        (matrix(INPUTS, 5, 4), bias(5, 4), A.relu), (matrix(5, 4, 5), bias(4, 5), A.tanh), (matrix(4, 2, 6), bias(2, 6), A.softmax)])
    return vectors(t).select("id", p.alias("p")).select("id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


@query("softmax", PROBS_SQL + "SELECT id, (list_position(x, list_max(x)) - 1)::INT AS class, round(list_max(x), 6) AS p FROM p")
def softmax(t):
    return probabilities(t).select("id", A.argmax("p").alias("class"), F.round(F.array_max("p"), 6).alias("p"))


@query("cross_entropy", PROBS_SQL + "SELECT count(*) AS n, round(avg(-ln(x[label + 1] + 1e-9)), 6) AS loss FROM p")
def cross_entropy(t):
    return probabilities(t).agg(F.count("*").alias("n"), F.round(F.avg(A.log_loss("label", "p")), 6).alias("loss"))


@query("one_hot", """
SELECT vec_id AS id, array_to_string(list_transform(range(10), lambda i: (i = label)::INT), ',') AS hot FROM embeddings
""")
def one_hot(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.array_join(
        A.one_hot("label", CLASSES).cast("array<string>"), ",").alias("hot"))


@query("rescale", """
SELECT vec_id AS id, unnest(range(64))::INT AS slot, round(unnest(embedding)::DOUBLE / 255, 9) AS value FROM embeddings
""")
def rescale(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode(A.rescale("embedding", 255)).alias("slot", "v")).select(
        "id", "slot", F.round("v", 9).alias("value"))
