"""Model quality measures as aggregates over (label, prediction or score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import SINGLE_TASK_ROWS, running_totals
from .profile import STATS, with_stats


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """n, R², root mean squared error and mean absolute error in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pairs = df.where(y.isNotNull() & p.isNotNull())
    err = y - p
    return pairs.agg(
        F.count("*").alias("n"),
        (F.lit(1.0) - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count("*"))).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    )


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every (actual, predicted) pair of the occurring classes, zero cells included. The counts, one
    per pair of classes, are folded into one row so the source is read once."""
    cells = confusion_counts(df, label, prediction).agg(F.collect_list(F.struct("actual", "predicted", "n")).alias("cells"))
    classes = F.array_distinct(F.concat(F.col("cells.actual"), F.col("cells.predicted")))
    zero = F.lit(0).cast("bigint").alias("n")
    zeros = F.flatten(F.transform(classes, lambda a: F.transform(
        classes, lambda b: F.struct(a.alias("actual"), b.alias("predicted"), zero))))
    return (
        cells.select(F.explode(F.concat("cells", zeros)).alias("c")).select("c.*")
        .groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.
    A ratio with nothing below the line is 0."""
    counts = confusion_counts(df, label, prediction)
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("chosen"),
                 F.lit(0).cast("bigint").alias("hit")),
    ))
    per_class = (
        counts.select(sides.alias("s")).select("s.*").groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hit")])
        .select("class", "support", "hit", _ratio(F.col("hit"), F.col("chosen")).alias("precision"),
                _ratio(F.col("hit"), F.col("support")).alias("recall"))
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    names = ("precision", "recall", "f1")
    total = per_class.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hit"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
        F.collect_list(F.struct(F.col("class").cast("string").alias("class"), *names, "support")).alias("lines"),
    )
    accuracy = _ratio(F.col("hit"), F.col("n"))

    def line(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(c) for c, v in zip(names, values)],
                        F.col("n").alias("support"))

    summary = F.array(
        line("accuracy", [accuracy] * 3),
        line("macro avg", [F.col(f"macro_{c}") for c in names]),
        line("weighted avg", [F.col(f"weighted_{c}") for c in names]),
    )
    return total.select(F.explode(F.concat("lines", summary)).alias("s")).select("s.*")


def _score_totals(df: DataFrame, label: str, score: str, single_task_rows: int) -> DataFrame:
    """One row per distinct score, highest first, with positives and negatives at or above it.

    The counts per score are written once: scores often come from a model, and neither the size
    check nor the totals should have it score every row again."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    groups = materialize(rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    return running_totals(groups, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, groups.count(), single_task_rows)


def roc_auc(df: DataFrame, label: str, score: str, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Exact area under the curve: the share of (positive, negative) pairs ranked right, ties half.
    NULL when a class is missing."""
    t = _score_totals(df, label, score, single_task_rows)
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    right = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return t.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                 F.try_divide(right, p * n).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, and the origin at threshold infinity."""
    t = _score_totals(df, label, score, single_task_rows)
    both = F.col(STATS)
    points = with_stats(t, t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).select(F.col("score").alias("threshold"), F.try_divide(F.col("fp"), both["n"]).alias("fpr"),
                      F.try_divide(F.col("tp"), both["p"]).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """Stack one-row metric tables, each model with its own numbers."""
    out = None
    for name, metrics in results.items():
        one = metrics.select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no models given")
    return out
