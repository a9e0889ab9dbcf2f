"""Every registered query against its SQL twin, and the shape of the plans."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from riskweave import plans

FOLDER = "/root/testdata/sf0.001"
MODELS = {"clv_models", "grid_search", "smote_logistic", "coefficients", "grounded_questions", "latent_retrieval", "tree_shap", "late_payment_model", "intent_model"}
# Fitted while the query is built; what remains in the plan walks isolation trees or scores.
# Full-size fits take minutes; check.py compares these on sf0.01.
SLOW = {"fraud_models", "score_applicants", "score_orders", "importance", "boosted_fraud", "order_fraud_run"}
FITTED = {"predicted_tiers", "order_fraud_run", "boosted_fraud", "open_forest", "fraud_models", "score_applicants", "score_orders", "isolation_forest", "importance", "model_reload", "embed_text"}
# Python is used only where vectors are searched, words looked up, blocks multiplied, trees grown or walked.
PYTHON = {"stored_index", "encode_tokens", "encode_pad", "retrieve_topk", "context_prompt", "confusion_multiclass", "smote", "corr_matrix", "top_coefficients"}
# Windows over a whole table whose size was checked or is fixed by a limit.
BOUNDED = {"vocabulary", "encode_tokens", "encode_pad", "roc_auc", "roc_curve", "label_encode", "category_codes", "smote", "sparse_categories"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(set(plans.oracle_sql()) - SLOW))
def test_matches_sql(spark, con, name):
    assert compare(spark, FOLDER, con, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - MODELS - FITTED))
def test_plan_shape(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|MapInArrow|MapInPandas|FlatMap\w*InPandas|BatchEvalPython|ArrowEval", plan)
    if name not in BOUNDED:
        assert not re.search(r"Window \[[^\n]*\], \[\w+#\d+[^\]]*\]\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_everything_has_a_check():
    assert set(plans.queries()) - set(plans.oracle_sql()) == MODELS


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["c_mktsegment", "n", "risk", "low", "medium", "high"] and got.count() == 5
