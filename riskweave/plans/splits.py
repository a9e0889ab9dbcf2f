"""Splits, folds and oversampling."""

from pyspark.sql import functions as F

from ..operators import neighbours, sampling
from .registry import hash_sql, query


@query("random_split", f"SELECT doc_id, ({hash_sql('doc_id', 42)} < 858993459)::INT AS is_test FROM documents")
def random_split(t):
    return sampling.random_split(t.documents.select("doc_id"), "doc_id", 0.2, 42)


@query("validation_tail", f"""
SELECT doc_id, ({hash_sql('doc_id', 7)} < 858993459)::INT AS is_val FROM documents WHERE {hash_sql('doc_id', 42)} >= 858993459
""")
def validation_tail(t):
    train = sampling.random_split(t.documents.select("doc_id"), "doc_id", 0.2, 42).where("is_test = 0").drop("is_test")
    return sampling.validation_tail(train, "doc_id", 0.2, 7)


@query("stratified_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42')) AS rn,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, (rn <= floor(0.2 * n + 0.5))::INT AS is_test FROM r
""")
def stratified_split(t):
    return sampling.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2, 42)


@query("group_split", f"""
WITH h AS (SELECT o_orderkey, o_custkey, {hash_sql('o_custkey', 42)} AS h FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN h < 858993459 THEN 'test' WHEN h < 1288490189 THEN 'val' ELSE 'train' END AS part FROM h
""")
def group_split(t):
    return sampling.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 0.125, 42)


@query("kfold_counts", f"""
SELECT ({hash_sql('o_orderkey', 42)} % 3)::INT AS fold, count(*) AS n FROM orders GROUP BY 1
""")
def kfold_counts(t):
    return sampling.kfold(t.orders.select("o_orderkey"), "o_orderkey", 3, 42).groupBy("fold").agg(F.count("*").alias("n"))


@query("smote", f"""
WITH d AS (SELECT d.doc_id, quality, n_chars::DOUBLE AS n_chars,
                  (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS n_lines
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS code FROM d WHERE quality = 0),
size AS (SELECT count(*) FILTER (quality = 0) AS few, count(*) - 2 * count(*) FILTER (quality = 0) AS need FROM d),
near AS (SELECT a.doc_id AS id, b.n_chars, b.n_lines,
                row_number() OVER (PARTITION BY a.doc_id ORDER BY (a.n_chars - b.n_chars) ** 2 + (a.n_lines - b.n_lines) ** 2, b.doc_id) AS rank
         FROM m a JOIN m b ON a.doc_id <> b.doc_id),
draw AS (SELECT {hash_sql("i || ':base'", 30, 15)} % few AS code, {hash_sql("i || ':near'", 30)} % LEAST(5, few - 1) + 1 AS rank,
                {hash_sql("i || ':step'", 30)} / 4294967296.0::DOUBLE AS u
         FROM (SELECT unnest(range(need)) AS i, few FROM size))
SELECT doc_id, quality, n_chars, n_lines, 0 AS synthetic FROM d
UNION ALL
SELECT NULL, 0, round(m.n_chars + u * (n.n_chars - m.n_chars), 6), round(m.n_lines + u * (n.n_lines - m.n_lines), 6), 1
FROM draw JOIN m ON draw.code = m.code JOIN near n ON n.id = m.doc_id AND n.rank = draw.rank
""")
def smote(t):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", "n_chars", lines.alias("n_lines"))
    out = neighbours.smote(rows, "doc_id", "quality", ["n_chars", "n_lines"], minority=0, k=5, seed=30)
    return out.withColumns({c: F.round(c, 6) for c in ("n_chars", "n_lines")})
