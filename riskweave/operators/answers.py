"""Retrieval-grounded question answering: prompts, evaluation grid, refusal checks, reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .neighbours import nearest


def grid(questions: DataFrame, templates: Mapping[str, str], fields: Mapping[str, Column | str]) -> DataFrame:
    """Every question with every template, rendered. The templates are a fixed handful, so each
    row fans out in place; nothing is joined or shuffled."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("template_no"), F.lit(name).alias("prompt_type"),
                 X.render_prompt(t, fields).alias("full_prompt"))
        for i, (name, t) in enumerate(templates.items(), 1)
    ]))
    return questions.select("*", cells.alias("_g")).select(*questions.columns, "_g.*")


def hallucination_flag(answer: Column | str, unanswerable: Column, phrase: str = X.REFUSAL) -> Column:
    """True when a question without an answer in its context was answered instead of refused."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    return ~F.coalesce(X.contains_phrase(answer, phrase), F.lit(False)) & F.coalesce(unanswerable, F.lit(False))


def evaluation_grid(
    questions: DataFrame, answers: DataFrame, unanswerable: Column, phrase: str = X.REFUSAL,
    question_no: str = "question_no", answer_on: tuple[str, ...] = ("question_no",),
    templates: Mapping[str, str] = X.GROUNDING_TEMPLATES,
) -> DataFrame:
    """Grid rows with the given answers and the hallucination flag. ``answers`` comes from a table
    (question number, optionally the prompt type, and ``answer``)."""
    rows = grid(questions, templates, {"question": "question", "context": "context"})
    return (
        rows.join(answers, list(answer_on), "left")
        .withColumn("hallucination", hallucination_flag("answer", unanswerable, phrase))
        .select(question_no, "question", "prompt_type", "answer", "hallucination", "full_prompt")
    )


def evaluation_summary(results: DataFrame, flag: str = "hallucination", by: str | None = None) -> DataFrame:
    """Tests, hallucinations and accuracy in percent, over all rows or per ``by``."""
    grouped = results.groupBy(by) if by else results.groupBy()
    bad = F.count_if(F.col(flag))
    return grouped.agg(
        F.count("*").alias("total_tests"), bad.alias("hallucinations"),
        F.try_divide(F.lit(100.0) * (F.count("*") - bad), F.count("*")).alias("accuracy"))


def review_status(answers: DataFrame, label: str, answer: str, phrase: str = X.COMPLIANCE_REFUSAL) -> DataFrame:
    """Answers per review label, how many contain the refusal and how many are nothing else."""
    # Quotes and a full stop around the phrase do not make it more than a refusal.
    bare = F.btrim(X.strip(answer), F.lit("\"'."))
    return answers.groupBy(label).agg(
        F.count("*").alias("n"),
        F.count_if(X.contains_phrase(answer, phrase)).alias("n_refusal"),
        F.count_if(bare == phrase).alias("n_only_refusal"))


def context_prompt(
    questions: DataFrame, corpus: DataFrame, k: int = 1, template: str = X.COMPLIANCE,
    query_id: str = "query_id", corpus_id: str = "id", text: str = "text", vector: str = "embedding",
) -> DataFrame:
    """Retrieve the k nearest texts per question and render one grounded prompt per question.
    ``k`` texts follow each other by rank, an empty line between them."""
    hits = nearest(questions, corpus, k, query_id, corpus_id, vector)
    texts = corpus.select(F.col(corpus_id).alias("neighbour_id"), F.col(text).alias("_context"))
    context = (
        hits.join(texts, "neighbour_id")
        .groupBy(query_id)  # k rows per question
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_context"))).alias("_c"))
        .select(query_id, F.array_join(F.transform("_c", lambda s: s["_context"]), "\n\n").alias("context"))
    )
    return questions.join(context, query_id).select(
        query_id, "question", "context",
        X.render_prompt(template, {"context": "context", "question": "question"}).alias("prompt"))


def render_report(results: DataFrame, out: str = "block") -> DataFrame:
    """One text block per result row, closed by a separator line."""
    return results.withColumn(out, F.concat_ws(
        "\n",
        F.concat(F.lit("Question "), F.col("question_no").cast("string"), F.lit(": "), F.col("question")),
        F.concat(F.lit("Prompt Type: "), F.col("prompt_type")),
        F.concat(F.lit("Answer: "), F.coalesce("answer", F.lit(""))),
        F.concat(F.lit("Hallucination: "), F.when(F.col("hallucination"), F.lit("Yes")).otherwise(F.lit("No"))),
        F.lit("-" * 80),
    ))
