"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a good and a bad document says that the first is preferred. The chance of that is the logistic function
of the difference of the documents' scores, and a score is linear in the features, so the weights come from logistic
regression on differences of features, without an intercept. Ranking leaves open where good begins; the threshold is
the quantile of the training scores that leaves as many documents above it as there are good ones.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import numbered

PAIRS = 8  # pairs drawn for each labelled row
MARKS = string.punctuation.encode()
LETTERS = (string.ascii_lowercase.encode(), string.ascii_uppercase.encode(), string.digits.encode(), b" ", b"\n")


def features_of(text: str) -> list[float]:
    """What a text looks like: shares of kinds of bytes and of single marks, and how words and lines repeat."""
    data = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    groups = [counts[list(g)].sum() / n for g in LETTERS] + [counts[128:].sum() / n, counts[list(MARKS)].sum() / n]
    marks = np.sqrt(counts[list(MARKS)] / n)
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    repeated = sum(map(str.__eq__, words, words[1:])) / k
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    shape = [np.log1p(len(words)), len(set(words)) / k, repeated, float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
             len(set(lines)) / len(lines), sum(map(str.istitle, words)) / k, sum(map(str.isupper, words)) / k]
    return [*map(float, groups), *marks.tolist(), *shape]


WIDTH = len(features_of(""))


def features(text: str | Column) -> Column:
    """Feature array of whole texts; null counts as empty."""

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([features_of(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return numbers(text)


@dataclass(frozen=True)
class Ranking:
    weights: tuple[float, ...]
    threshold: float

    def score(self, text: str | Column) -> Column:
        """Chance in (0, 1) that a whole text ranks above the threshold; null and empty texts are scored like others."""
        weights, threshold = np.array(self.weights), self.threshold

        @F.arrow_udf("double")
        def chance(texts: pa.Array) -> pa.Array:
            raw = np.array([np.dot(features_of(t.as_py() or ""), weights) for t in texts], np.float64) - threshold
            return pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

        return chance(text)


def fit(sample: DataFrame, pairs: int = PAIRS, reg: float = 1e-4) -> Ranking:
    """Weights and threshold from all rows (key, text, label) as ``training.labelled_rows`` finds them. With rows of one
    label only there is nothing to prefer: all scores are 0.5."""
    held = materialize(sample.select("key", "label", features("text").alias("x")))
    size = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = size.get(1, 0), size.get(0, 0)
    if not good or not bad:
        return Ranking((0.0,) * WIDTH, 0.0)
    # Bad rows come first, so a place also numbers the rows of a label.
    rows = numbered(held, "i", "label", F.xxhash64("key"), "key", "x").withColumn("i", (F.col("i") - F.col("label") * bad).cast("int"))
    draws = rows.select("label", "i", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("r"))
    other = lambda n, seed: F.pmod(F.xxhash64("i", "r", F.lit(seed)), F.lit(n)).cast("int")
    drawn = draws.select(F.when(F.col("label") == 1, F.col("i")).otherwise(other(good, 1)).alias("g"),
                         F.when(F.col("label") == 0, F.col("i")).otherwise(other(bad, 0)).alias("b"), "r").distinct()
    of = lambda label, i, x: rows.where(F.col("label") == label).select(F.col("i").alias(i), F.col("x").alias(x))
    both = drawn.join(of(1, "g", "xg"), "g").join(of(0, "b", "xb"), "b")
    # Every other preference is stated the other way round, so that both outcomes occur.
    way = F.when(F.col("r") % 2 == 0, 1.0).otherwise(-1.0)
    train = both.select(array_to_vector(F.zip_with("xg", "xb", lambda g, b: (g - b) * way)).alias("features"), (way > 0).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=60).fit(train)  # keeps its rows in blocks by itself
    raw = model.transform(rows.select(array_to_vector("x").alias("features"))).select(vector_to_array("rawPrediction")[1].alias("s"))
    place = bad / (good + bad) * (good + bad - 1)
    low = int(place)
    near = [r["s"] for r in numbered(raw, "i", "s").where(F.col("i").isin(low, low + 1)).orderBy("i").collect()]
    threshold = near[0] + (place - low) * (near[-1] - near[0])
    return Ranking(tuple(map(float, model.coefficients.toArray())), float(threshold))
