"""Mixing against its rules and the SQL twin, on sources of very unequal size."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from riskweave.llm import mixing
from riskweave.llm.queries import QUERIES, SQL

SIZES = {"hot": 2400, "b": 900, "c": 700, None: 500, "e": 60, "none": 30}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, " ".join(["w"] * ((i * 7919) % 23 + 1)) if s != "none" else " \n", s) for i, s in enumerate(s for s, n in SIZES.items() for _ in range(n))]
    folder = str(tmp_path_factory.mktemp("mix"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def test_sql_twin(spark, corpus):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{corpus}/documents.parquet/*.parquet')")
    got = QUERIES["op10_mixing"](spark, corpus)
    cur = con.execute(SQL["op10_mixing"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want and len(want) > 3000


@pytest.mark.parametrize("parameters", [{}, {"entropy_share": 1.0}, {"entropy_share": 0.1}, {"repeats": 1.0}, {"budget_share": 0.3}, {"budget_share": 2.5, "repeats": 8.0}])
def test_weights_and_budgets(spark, corpus, parameters, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("n", mixing.token_count("text"))
    plans = mixing.plan(docs, "doc_id", "source", "n", **parameters)
    rows = [r for r in plans.collect() if r.tokens]
    total, share, least, limit = sum(r.tokens for r in rows), parameters.get("budget_share", 1.0), parameters.get("entropy_share", 0.95), parameters.get("repeats", 4.0)
    assert sum(r.weight for r in rows) == pytest.approx(1)
    entropy = -sum(r.weight * math.log(r.weight) for r in rows) / math.log(len(rows))
    passes = max(r.weight * total * share / r.tokens for r in rows)
    natural = -sum(r.tokens / total * math.log(r.tokens / total) for r in rows) / math.log(len(rows))
    assert entropy >= min(least, 1) - 1e-6 or passes == pytest.approx(max(limit, share), rel=1e-4)
    assert passes <= max(limit, share) * (1 + 1e-6) and entropy >= natural - 1e-9
    mixed = mixing.realise(docs, "doc_id", "source", plans)
    got = {r["_s"]: (r.spent, r.most, r.least) for r in mixed.groupBy("source", "doc_id", "n").count().groupBy(F.coalesce("source", F.lit("\x00")).alias("_s")).agg(
        F.sum(F.col("n") * F.col("count")).alias("spent"), F.max("count").alias("most"), F.min("count").alias("least")).collect()}
    longest = 23
    for r in rows:
        spent, most, least_copies = got.get(r["_source"], (0, 0, 0))
        assert r.budget - longest < spent <= r.budget <= r.tokens * limit
        assert most - least_copies <= 1 and most <= math.ceil(limit)
    assert mixed.where("source = 'none'").count() == 0


def test_copies_have_their_places(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("n", mixing.token_count("text"))
    mixed = mixing.realise(docs, "doc_id", "source", mixing.plan(docs, "doc_id", "source", "n"))
    assert mixed.groupBy("doc_id", "pass").count().where("count > 1").count() == 0
    assert mixed.columns == [*docs.columns, "pass", "place"]


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, source string, docs string"
    assert mixing.mix(spark.createDataFrame([], schema), "doc_id", "source", "text").count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a", "x"), (2, "", None, "y")], schema), "doc_id", "source", "text").count() == 0
    rows = [(1, "a b", "s", "x")] * 3 + [(None, "c", None, "y")]
    assert mixing.mix(spark.createDataFrame(rows, schema), "doc_id", "source", "text", entropy_share=0.1).count() == 4


def test_no_python_in_the_plan(spark, corpus):
    plan = QUERIES["op10_mixing"](spark, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sources_beyond_the_broadcast(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("n", mixing.token_count("text"))
    run = lambda: sorted((tuple(r) for r in mixing.realise(docs, "doc_id", "source", mixing.plan(docs, "doc_id", "source", "n")).collect()), key=repr)
    want = run()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr("riskweave.llm.common.HOT_ROWS", 600)
    assert run() == want




def test_clashing_names(spark):
    rows = [(i, "a b", "s", "x", "y", "z", "w") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, pass string, place string, _source string, block string")
    mixed = mixing.mix(docs, "doc_id", "source", "text")
    assert mixed.columns == docs.columns and sorted(tuple(r) for r in mixed.collect()) == rows
    plans = mixing.plan(docs.withColumn("n", mixing.token_count("text")), "doc_id", "source", "n")
    with pytest.raises(ValueError, match="pass"):
        mixing.realise(docs, "doc_id", "source", plans)
