"""Quality measures of scores and predictions."""

from pyspark.sql import functions as F

from ..functions.columns import decide
from ..operators import metrics, neighbours
from .profiling import rounded
from .registry import query

SCORED_SQL = """
WITH s AS (SELECT l.doc_id, quality AS y, LEAST(n_chars / 3000.0::DOUBLE, 1) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT p AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY p),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))
"""


def scored(t):
    """Labelled documents with their length as a score."""
    docs = t.documents.select("doc_id", "n_chars")
    return t.labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / F.lit(3000.0), F.lit(1.0)).alias("p"))


@query("regression_metrics", """
WITH r AS (SELECT l_extendedprice AS y, 1500.0::DOUBLE * l_quantity AS p FROM lineitem)
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
       round(avg(abs(y - p)), 4) AS mae FROM r
""")
def regression_metrics(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.lit(1500.0) * F.col("l_quantity")).alias("p"))
    m = metrics.regression_metrics(rows, "y", "p")
    return m.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("confusion", SCORED_SQL + """,
c AS (SELECT unnest([0, 1])::INT AS c)
SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM s WHERE y = a.c AND (p >= 0.5)::INT = b.c) AS n FROM c a, c b
""")
def confusion(t):
    rows = scored(t).select("y", decide("p").alias("hat"))
    return metrics.confusion_matrix(rows, "y", "hat")


@query("class_report", SCORED_SQL + """,
h AS (SELECT y, (p >= 0.5)::INT AS hat FROM s),
c AS (SELECT c, (SELECT count(*) FROM h WHERE y = c) AS support, (SELECT count(*) FROM h WHERE hat = c) AS chosen,
             (SELECT count(*) FROM h WHERE y = c AND hat = c) AS hit FROM (SELECT unnest([0, 1]) AS c)),
m AS (SELECT c, support, hit, COALESCE(hit / nullif(chosen, 0), 0) AS p, COALESCE(hit / nullif(support, 0), 0) AS r FROM c),
f AS (SELECT *, COALESCE(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)
SELECT c::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f
""")
def class_report(t):
    rows = scored(t).select("y", decide("p").alias("hat"))
    return rounded(metrics.classification_report(rows, "y", "hat"))


@query("roc_auc", SCORED_SQL + """
SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
       round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc FROM r
""")
def roc_auc(t):
    return rounded(metrics.roc_auc(scored(t), "y", "p"))


@query("roc_curve", SCORED_SQL + """
SELECT round(score, 6) AS threshold, round(fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(tp / (SELECT sum(pos) FROM g), 6) AS tpr FROM r
UNION ALL SELECT 'infinity'::DOUBLE, 0, 0
""")
def roc_curve(t):
    curve = metrics.roc_curve(scored(t), "y", "p")
    return curve.select(F.when(F.col("threshold") < float("inf"), F.round("threshold", 6)).otherwise(F.col("threshold")).alias("threshold"),
                        F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


NEAREST_SQL = """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, a.label, b.label AS other,
                  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2 AS distance
           FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbour_id) AS rank FROM d)
"""


@query("confusion_multiclass", NEAREST_SQL + """,
h AS (SELECT label AS actual, other AS predicted FROM n WHERE rank = 1), c AS (SELECT DISTINCT label AS c FROM embeddings)
SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM h WHERE actual = a.c AND predicted = b.c) AS n FROM c a, c b
""")
def confusion_multiclass(t):
    """Every vector's label against the label of its nearest other vector."""
    vectors = t.embeddings
    near = neighbours.nearest(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 1, corpus_id="vec_id", exclude_self=True)
    label = vectors.select("vec_id", "label")
    rows = (
        near.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("actual")), "query_id")
        .join(label.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("predicted")), "neighbour_id")
    )
    return metrics.confusion_matrix(rows, "actual", "predicted")
