import pytest
from pyspark.sql import functions as F

from riskweave.functions import text as X
from riskweave.operators import answers as R
from riskweave.operators import words


@pytest.fixture(scope="module")
def grid(spark):
    """Three questions, three prompts, nine answers: only the loose prompt invents the third answer."""
    questions = spark.createDataFrame([(i, f"question {i}", "some context") for i in (1, 2, 3)], "question_no int, question string, context string")
    given = [(q, p, "an answer") for q in (1, 2) for p in X.GROUNDING_TEMPLATES]
    given += [(3, "Strict RAG", "Not found in context."), (3, "Medium RAG", "Not found in context."), (3, "Loose", "8 billion")]
    answers = spark.createDataFrame(given, "question_no int, prompt_type string, answer string")
    return R.evaluation_grid(questions, answers, F.col("question_no") == 3, answer_on=("question_no", "prompt_type"))


def test_grid_flags_one_of_nine(grid):
    total = R.evaluation_summary(grid).first()
    assert (total["total_tests"], total["hallucinations"]) == (9, 1) and round(total["accuracy"], 1) == 88.9
    flagged = grid.where("hallucination").first()
    assert (flagged["question_no"], flagged["prompt_type"]) == (3, "Loose")
    per = {r["question_no"]: r["hallucinations"] for r in R.evaluation_summary(grid, by="question_no").collect()}
    assert per == {1: 0, 2: 0, 3: 1}


def test_report_blocks(grid):
    block = R.render_report(grid.where("hallucination")).first()["block"].split("\n")
    assert block == ["Question 3: question 3", "Prompt Type: Loose", "Answer: 8 billion", "Hallucination: Yes", "-" * 80]


def test_missing_answer_counts_as_not_refused(spark):
    df = spark.createDataFrame([(None,), ("Not found in context.",)], "a string")
    assert [r[0] for r in df.select(R.hallucination_flag("a", F.lit(True))).collect()] == [True, False]


def test_review_status(spark, rows):
    df = spark.createDataFrame([("Pending", "Not enough information."), ("Pending", '"Not enough information."'),
                                ("Pending", "Yes. Not enough information on fees."), ("Good", "Yes")], "label string, answer string")
    assert rows(R.review_status(df, "label", "answer")) == [("Good", 1, 0, 0), ("Pending", 3, 3, 2)]


def test_context_prompt_joins_ranked_texts(spark):
    corpus = spark.createDataFrame([(1, "near", [0.0, 0.0]), (2, "next", [1.0, 0.0]), (3, "far", [9.0, 9.0])], "id long, text string, embedding array<double>")
    q = spark.createDataFrame([(7, "why?", [0.1, 0.0])], "query_id long, question string, embedding array<double>")
    assert R.context_prompt(q, corpus, 1).first()["context"] == "near"
    r = R.context_prompt(q, corpus, 2).first()
    assert r["context"] == "near\n\nnext" and "why?" in r["prompt"] and X.COMPLIANCE_REFUSAL in r["prompt"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "The cat, the dog"), (2, "a cat!"), (3, ""), (4, "zebra " * 12)], "id int, text string")


def test_vocabulary_order_and_limit(texts):
    vocab = words.fit_vocabulary(texts, "text")
    assert [tuple(r) for r in vocab.orderBy("word_id").collect()] == [
        ("zebra", 12, 2), ("cat", 2, 3), ("the", 2, 4), ("a", 1, 5), ("dog", 1, 6)]
    assert words.fit_vocabulary(texts, "text", max_words=4).count() == 2


@pytest.mark.parametrize("lookup_words", [1000, 1])
def test_encode_by_lookup_and_by_join(texts, lookup_words):
    vocab = words.fit_vocabulary(texts, "text", max_words=5)
    got = {r["id"]: r["ids"] for r in words.encode_tokens(texts, "id", "text", vocab, lookup_words=lookup_words).collect()}
    assert got == {1: [4, 3, 4, 1], 2: [1, 3], 3: [], 4: [2] * 12}
    fixed = {r["id"]: r["ids"] for r in words.encode_tokens(texts, "id", "text", vocab, 10, lookup_words).collect()}
    assert fixed == {i: (ids + [0] * 10)[:10] for i, ids in got.items()}


def test_corpus_and_paragraphs(spark):
    pages = spark.createDataFrame([("a", 2, "second "), ("a", 1, " first"), ("b", 1, "one\n\n \n\ntwo")], "name string, page int, text string")
    got = {r["name"]: r["text"] for r in words.load_corpus(pages.repartition(3), "name", "page", "text").collect()}
    assert got == {"a": "first\nsecond", "b": "one\n\n \n\ntwo"}
    parts = words.split_paragraphs(pages, "name", "text").where("name = 'b'").collect()
    assert [(r["paragraph_no"], r["paragraph"]) for r in parts] == [(0, "one"), (1, "two")]
    assert {tuple(r) for r in words.count_profile(pages, "name", "text").collect()} >= {("b", 2, 2)}
