"""Retrieval, grounded prompts and answer evaluation.

Questions are user turns, given answers the assistant turns that follow them. A late question
stands for one the context cannot answer, and the word 'the' for the refusal phrase.
"""

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as R
from ..operators import neighbours, vector_index
from ..session import shared_dir
from .profiling import rounded
from .quality import NEAREST_SQL
from .registry import query
from .texts import CLEAN, CORPUS, WORDS, corpus

PHRASE = "the"


@query("retrieve_topk", NEAREST_SQL + "SELECT query_id, rank::INT AS rank, neighbour_id, round(distance, 6) AS distance FROM n WHERE rank <= 3")
def retrieve_topk(t):
    vectors = t.embeddings.select("vec_id", "embedding")
    hits = neighbours.nearest(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 3, corpus_id="vec_id", exclude_self=True)
    return rounded(hits)


@query("stored_index", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 10 = 0),
n AS (SELECT query_id, vec_id AS neighbour_id, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a, embedding::DOUBLE[])]) AS distance
      FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM n)
SELECT query_id, rank::INT AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= 4
""")
def stored_index(t):
    """An index built from the even vectors, to which the odd ones are added later; then asked for the four nearest."""
    vectors = t.embeddings.select("vec_id", "embedding")
    path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    vector_index.build_index(vectors.where("vec_id % 2 = 0"), path, "vec_id")
    vector_index.append_index(vectors.where("vec_id % 2 <> 0"), path, "vec_id")
    asked = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    return rounded(vector_index.search_index(asked, path, 4, exclude_self=True))


def profile_sql(table, key):
    return (f"(SELECT {key} AS id, text, [floor(len([x FOR x IN d IF x = b]) * 1000 / greatest(len(d), 1)) FOR b IN range(16)] AS v FROM (SELECT {key}, text, "
            f"[('0x' || substr(md5(x), 1, 1))::BIGINT FOR x IN {WORDS.format(x=CLEAN)}] AS d FROM {table} WHERE text IS NOT NULL))")


@query("context_prompt", f"""
WITH q AS MATERIALIZED {profile_sql('benchmark', 'item_id')}, c AS MATERIALIZED {profile_sql('documents', 'doc_id')},
r AS (SELECT q.id AS query_id, q.text AS question, c.text, c.id, row_number() OVER (PARTITION BY q.id ORDER BY
             list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q.v, c.v)]), c.id) AS rank FROM q, c)
SELECT query_id, question, text AS context,
       'Answer for a compliance officer from this policy text.' || chr(10) || 'Policy:' || chr(10) || text || chr(10) || 'Question: ' || question
       || chr(10) || 'When the policy is silent, reply: Not enough information.' AS prompt
FROM r WHERE rank = 1
""")
def context_prompt(t):
    """Every document can be the context of a question; nearness is that of the texts' own word profiles."""
    profile = X.word_profile(X.clean_text("text")).alias("embedding")
    asked = t.benchmark.where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), profile)
    return R.context_prompt(asked, t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", profile), 1)


def questions(t):
    """User turns with their conversation as context."""
    asked = t.conversations.where("role = 'user'").select(
        "conv_id", F.col("turn").alias("question_no"), F.col("text").alias("question"))
    return asked.join(corpus(t).withColumnRenamed("text", "context"), "conv_id")


def given_answers(t):
    return t.conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("question_no"), F.col("text").alias("answer"))


def answered(t):
    return questions(t).join(given_answers(t), ["conv_id", "question_no"])


PAIRS_SQL = f"""
WITH c AS {CORPUS},
a AS (SELECT u.conv_id, u.turn AS question_no, u.text AS question, c.text AS context, s.text AS answer
      FROM conversations u JOIN c ON u.conv_id = c.conv_id
      JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 AND s.role = 'assistant' WHERE u.role = 'user')
"""

GRID_SQL = PAIRS_SQL + """,
p AS (SELECT *, 'Strict RAG' AS prompt_type, 'Use the passage and nothing else.' || chr(10) || 'Passage:' || chr(10) || context || chr(10)
        || 'Question:' || chr(10) || question || chr(10) || 'If the passage does not hold the answer, reply only: Not found in context.' AS full_prompt FROM a
      UNION ALL SELECT *, 'Medium RAG', 'Passage:' || chr(10) || context || chr(10) || 'Question:' || chr(10) || question || chr(10)
        || 'Prefer the passage. If it is silent, you may reply: Not found in context.' FROM a
      UNION ALL SELECT *, 'Loose', 'Background:' || chr(10) || context || chr(10) || 'Question:' || chr(10) || question FROM a),
g AS (SELECT *, NOT contains(answer, 'the') AND question_no >= 4 AS hallucination FROM p)
"""


def grid_rows(t):
    pairs = answered(t)
    rows = R.grid(pairs, X.GROUNDING_TEMPLATES, {"question": "question", "context": "context"})
    return rows.withColumn("hallucination", R.hallucination_flag("answer", F.col("question_no") >= 4, PHRASE))


@query("prompt_grid", PAIRS_SQL.rstrip() + """
SELECT conv_id, question_no, n AS template_no FROM a, (SELECT unnest([1, 2, 3])::INT AS n)
""")
def prompt_grid(t):
    rows = R.grid(answered(t), X.GROUNDING_TEMPLATES, {"question": "question", "context": "context"})
    return rows.select("conv_id", "question_no", "template_no")


@query("eval_grid", GRID_SQL + "SELECT conv_id, question_no, prompt_type, answer, hallucination, full_prompt FROM g")
def eval_grid(t):
    return grid_rows(t).select("conv_id", "question_no", "prompt_type", "answer", "hallucination", "full_prompt")


@query("halluc_flag", PAIRS_SQL + """
SELECT conv_id, question_no, NOT contains(answer, 'the') AND question_no >= 4 AS hallucination FROM a
""")
def halluc_flag(t):
    return answered(t).select("conv_id", "question_no", R.hallucination_flag(
        "answer", F.col("question_no") >= 4, PHRASE).alias("hallucination"))


@query("eval_summary", GRID_SQL + """,
s AS (SELECT question_no, hallucination FROM g)
SELECT question_no, count(*) AS total_tests, count(*) FILTER (hallucination) AS hallucinations,
       round(100.0::DOUBLE * (count(*) - count(*) FILTER (hallucination)) / count(*), 6) AS accuracy FROM s GROUP BY question_no
UNION ALL SELECT -1, count(*), count(*) FILTER (hallucination), round(100.0::DOUBLE * (count(*) - count(*) FILTER (hallucination)) / count(*), 6) FROM s
""")
def eval_summary(t):
    """Totals under question number -1, then one row per question number."""
    rows = grid_rows(t)
    total = R.evaluation_summary(rows).select(F.lit(-1).cast("bigint").alias("question_no"), "*")
    return rounded(R.evaluation_summary(rows, by="question_no").unionByName(total))


@query("review_status", f"""
SELECT lang, count(*) AS n, count(*) FILTER (contains(text, 'the')) AS n_refusal,
       count(*) FILTER (text = 'the') AS n_only_refusal FROM documents GROUP BY lang
""")
def review_status(t):
    return R.review_status(t.documents, "lang", "text", PHRASE)


@query("render_report", GRID_SQL + """
SELECT conv_id, 'Question ' || question_no || ': ' || question || chr(10) || 'Prompt Type: ' || prompt_type || chr(10) || 'Answer: ' || answer
  || chr(10) || 'Hallucination: ' || CASE WHEN hallucination THEN 'Yes' ELSE 'No' END || chr(10) || repeat('-', 80) AS block FROM g
""")
def render_report(t):
    return R.render_report(grid_rows(t)).select("conv_id", "block")
