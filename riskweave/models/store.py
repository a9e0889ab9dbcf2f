"""Saving fitted models and re-using them for scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decide
from .estimators import score
from .isolation import IsolationForestModel


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_batch(df: DataFrame, model: PipelineModel, forest: IsolationForestModel, threshold: float = 0.5) -> DataFrame:
    """Scoring run on fitted parts: the rows with ``proba``, ``flag``, ``iso_score`` and ``iso_flag``."""
    scored = score(model, df, "proba").withColumn("flag", decide("proba", threshold))
    return forest.flag(scored)


def compare_scores(a: PipelineModel, b: PipelineModel, df: DataFrame) -> DataFrame:
    """(n, n_different): on how many rows two models disagree, for a check after reloading."""
    both = score(b, score(a, df, "p_a"), "p_b")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("p_a").eqNullSafe(F.col("p_b"))).alias("n_different"))
