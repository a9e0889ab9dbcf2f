"""What follows a fit: predictions become tiers and actions, and flags are measured as a whole and per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import profile
from .estimators import classifier_metrics


def value_actions(model: Model, df: DataFrame, churn: str, probs: Sequence[float] = (0.0, 0.5, 0.8, 1.0),
                  labels: Sequence[str] = ("Low", "Medium", "High"), threshold: float = 0.5) -> DataFrame:
    """The rows with ``predicted``, the ``tier`` of its quantile among these rows, and the ``action`` for tier and churn risk."""
    predicted = model.transform(df).select(*df.columns, F.col("prediction").alias("predicted"))
    tiers = profile.quantile_tiers(predicted, "predicted", probs, labels)
    return tiers.withColumn("action", C.recommend_action("tier", churn, threshold))


def evaluate_flags(scored: DataFrame, models: Mapping[str, str], label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row per model, given as name and score column: AUC, accuracy, precision, recall and F1 at the threshold, and the four
    cells of the confusion matrix. A score equal to the threshold is a flag."""
    out = None
    for name, p in models.items():
        flag, truth = C.decide(p, threshold), F.col(label).cast("int")
        cells = scored.agg(*[F.count_if((truth == y) & (flag == h)).alias(cell)
                             for cell, y, h in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
        row = profile.one_row(cells)
        one = classifier_metrics(scored, label, p, threshold).select(
            F.lit(name).alias("model"), "*", *[row[c].alias(c) for c in ("tn", "fp", "fn", "tp")])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no models given")
    return out


def flag_rates(scored: DataFrame, groups: Sequence[str], flag: str) -> DataFrame:
    """(part, value, n, rate): the mean flag per value of every grouping column, in one pass; NULL is a value of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("part"), F.col(g).cast("string").alias("value")) for g in groups]))
    return scored.select(pairs.alias("_g"), F.col(flag).cast("double").alias("_f")).groupBy("_g.part", "_g.value").agg(
        F.count("*").alias("n"), F.avg("_f").alias("rate"))
