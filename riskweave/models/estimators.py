"""Spark ML estimators in the configurations the analytics need, and what is done with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    IDF, CountVectorizer, HashingTF, Normalizer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import metrics
from ..operators.prepare import scaler_stats
from .ensembles import RandomForest
from .gradient import GradientTrees

FEATURES = "features"


class PopulationScaler(Estimator):
    """z-scores with the population deviation, constant columns to 0. Fitting yields a plain
    SQL projection, so a fitted pipeline saves and loads without this class."""

    def __init__(self, cols: Sequence[str], suffix: str = "_z"):
        super().__init__()
        self.cols, self.suffix = list(cols), suffix

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        s = scaler_stats(dataset, self.cols).first()
        terms = [
            f"(CAST(`{c}` AS DOUBLE) - CAST({s[c]['mean']!r} AS DOUBLE)) / CAST({(s[c]['std'] or 1.0)!r} AS DOUBLE) AS `{c}{self.suffix}`"
            if s[c]["mean"] is not None else f"CAST(0.0 AS DOUBLE) AS `{c}{self.suffix}`"  # nothing is known of the column
            for c in self.cols
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def preprocess_stages(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True,
                      out: str = FEATURES) -> list:
    """Scaled numerics next to one-hot categoricals in one vector. A category not seen while
    fitting gives all zeros."""
    stages: list = [PopulationScaler(numeric)] if scale and numeric else []
    if categorical:
        index = [f"{c}_index" for c in categorical]
        hot = [f"{c}_hot" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=index,
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
    else:
        hot = []
    inputs = [f"{c}_z" if scale else c for c in numeric] + hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out))
    return stages


def feature_names(df: DataFrame, col: str = FEATURES) -> list[str]:
    """Slot names of an assembled vector from its column metadata."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    slots = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]


# ---------------------------------------------------------------- estimators

def linear_regression(label: str = "label") -> LinearRegression:
    """Least squares. One-hot columns add up to the intercept, which leaves the plain solution
    undetermined; a vanishing penalty picks the one with the smallest coefficients."""
    return LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=1e-9, elasticNetParam=0.0,
                            standardization=False, solver="normal")


def logistic_regression(rows: int, label: str = "label", weight: str | None = None) -> LogisticRegression:
    """L2 with unit strength over the summed loss; Spark averages the loss, hence 1 / rows."""
    est = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=1000, regParam=1.0 / max(rows, 1),
                             elasticNetParam=0.0, standardization=False)
    return est.setWeightCol(weight) if weight else est


def random_forest_classifier(label: str = "label", trees: int = 200, depth: int = 10,
                             weight: str | None = None, seed: int = 42) -> RandomForest:
    return RandomForest(FEATURES, label, trees, depth, seed, classes=True, weight=weight)


def random_forest_regressor(label: str = "label", trees: int = 200, depth: int = 10, seed: int = 42) -> RandomForest:
    """Every column is tried at every node."""
    return RandomForest(FEATURES, label, trees, depth, seed, classes=False, columns=1 << 30)


def gbt_regressor(label: str = "label", rounds: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)


def boosted_regressor(label: str = "label", rounds: int = 100, depth: int = 6, rate: float = 0.3) -> GradientTrees:
    """The trees of :func:`gbt_regressor`, which remains for searches over Spark's parameters, in few jobs."""
    return GradientTrees(FEATURES, label, rounds, depth, rate, classes=False)


def gbt_classifier(label: str = "label", rounds: int = 150, depth: int = 5, rate: float = 0.1,
                   weight: str | None = None, validation: str | None = None) -> GradientTrees:
    """``validation`` names a boolean column; rows marked true stop the boosting early."""
    return GradientTrees(FEATURES, label, rounds, depth, rate, weight=weight, validation=validation)


def grid_search(stages: Sequence, model, grid: Mapping[str, Sequence], fold: str, folds: int = 3,
                label: str = "label", parallelism: int = 4) -> CrossValidator:
    """Every combination of ``grid`` (parameter name to values) scored by R² on given folds; the
    best one is refit on all rows."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    return CrossValidator(
        estimator=Pipeline(stages=[*stages, model]), estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2"),
        numFolds=folds, foldCol=fold, parallelism=parallelism,
    )


def grid_results(model: CrossValidatorModel, spark) -> DataFrame:
    """One row per combination with its mean R² and whether it won."""
    best = max(range(len(model.avgMetrics)), key=model.avgMetrics.__getitem__)
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)),
         float(model.avgMetrics[i]), i == best)
        for i, m in enumerate(model.getEstimatorParamMaps())
    ]
    return spark.createDataFrame(rows, "candidate int, params string, mean_r2 double, is_best boolean")


# ---------------------------------------------------------------- scores

def positive_probability(scored: DataFrame) -> Column:
    """Probability of class 1; a linear model's output is bounded to [0, 1] instead."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return C.clip("prediction", 0.0, 1.0)


def score(model: Model, df: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*df.columns, positive_probability(scored).alias(out))


def score_applicants(df: DataFrame, models: Mapping[str, Model], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per applicant and model: Yes/No, probability and Accept / Review / Reject, and the columns to keep."""
    out = None
    for name, model in models.items():
        p = F.col("p")
        one = score(model, df).select(
            key, *keep, F.lit(name).alias("model"), C.yes_no(p).alias("predicted_default"),
            F.round(p, 3).alias("default_probability"),
            C.risk_bucket(p, [0.30, 0.60], ["Accept", "Review", "Reject"], closed="right").alias("risk_bucket"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no models given")
    return out


def classifier_metrics(df: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row: AUC, accuracy, and precision, recall and F1 of the positive class."""
    flagged = df.select(F.col(label).cast("int").alias("y"), F.col(p).alias("p"), C.decide(p, threshold).alias("hat"))
    auc = metrics.roc_auc(flagged, "y", "p").select("auc").scalar()
    tp, fp, fn = (F.count_if((F.col("y") == y) & (F.col("hat") == h)) for y, h in ((1, 1), (0, 1), (1, 0)))
    zero = F.lit(0.0)
    one = flagged.agg(
        F.count("*").alias("n"), F.avg((F.col("y") == F.col("hat")).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"))
    return one.select("n", auc.alias("auc"), "accuracy", "precision", "recall", "f1")


# ---------------------------------------------------------------- text models

def with_words(df: DataFrame, text: str, out: str = "words") -> DataFrame:
    return df.withColumn(out, X.tokenize(X.clean_text(text)))


def intent_stages(label: str, rows: int, max_words: int = 5000) -> list:
    """Word counts over the most frequent words into a multinomial logistic model."""
    return [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"),
        CountVectorizer(inputCol="words", outputCol=FEATURES, vocabSize=max_words, minDF=1.0),
        LogisticRegression(featuresCol=FEATURES, labelCol="label", family="multinomial", maxIter=100,
                           regParam=1.0 / max(rows, 1)),
    ]


def fit_embedder(df: DataFrame, text: str, dim: int = 256) -> PipelineModel:
    """Text to a unit-length vector of hashed word weights: no pretrained weights needed."""
    return Pipeline(stages=[
        HashingTF(inputCol="words", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]).fit(with_words(df, text))


def embed_text(model: PipelineModel, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    embedded = model.transform(with_words(df, text))
    return embedded.select(*df.columns, vector_to_array("_unit", "float32").alias(out))
