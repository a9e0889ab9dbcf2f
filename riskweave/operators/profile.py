"""Profiling aggregates and the columns derived from whole-table statistics.

Whole-table statistics are one-row tables that enter the row expressions as scalar subqueries:
no cross join, nothing collected, and the same statistic used twice is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .comoments import comoments, correlations
from .ordering import quantile_row
from .sketches import described, exact_quantiles, profile_parts


STATS = "_stats"
QUARTILES = (0.25, 0.5, 0.75)


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery."""
    return stats.select(F.struct(*[F.col(c) for c in stats.columns])).scalar()


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The one-row table as a struct column ``_stats``. Expressions then refer to the column, so the
    plan holds a single subquery however often a statistic is used."""
    return df.withColumn(STATS, one_row(stats))


def columns_of_type(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> list[str]:
    """``numeric`` or ``string`` columns by schema, in schema order."""
    wanted = {"numeric": T.NumericType, "string": T.StringType}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted) and f.name not in exclude]


def numeric_matrix(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """All numeric columns but the excluded ones, NULL and NaN replaced by 0."""
    cols = columns_of_type(df, "numeric", exclude)
    return df.select(*cols).fillna(0, cols)


def value_counts(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """Rows per value, commonest first. NULL is no value unless asked for."""
    rows = df if keep_null else df.where(F.col(col).isNotNull())
    return rows.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col))


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Exact number of distinct values of each column, each de-duplicated on its own shuffle
    instead of expanding every row once per column."""
    out = None
    for c in cols:
        one = (
            df.select(F.col(c).alias("v")).where("v IS NOT NULL").distinct()
            .agg(F.count("*").alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct")
        )
        out = one if out is None else out.unionByName(one)
    return out


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, pct_missing) from one pass. NaN counts as missing."""
    cols = list(cols or df.columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def gone(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    one = df.agg(F.count("*").alias("_n"), *[F.count_if(gone(c)).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in cols]))
    return one.select("_n", pairs.alias("p")).select(
        "p.column", "p.n_missing", (100.0 * F.try_divide(F.col("p.n_missing"), F.col("_n"))).alias("pct_missing")
    )


def describe(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, quartiles, max. NULL and NaN are missing. The table is read
    twice, once for the profile and once for exact quartiles; ``approx=True`` leaves out the second time."""
    parts = materialize(profile_parts(df, cols))
    found = described(parts, QUARTILES)
    if not approx:
        exact = exact_quantiles(df, {c: QUARTILES for c in cols}, parts)
        rows = df.sparkSession.createDataFrame(list(exact.items()), "column string, exact array<double>")
        found = found.join(F.broadcast(rows), "column").withColumn("quantiles", F.col("exact"))  # a row per column
    return found.select("column", "n", "mean", "std", "min", *[F.get("quantiles", F.lit(i)).alias(f"p{round(100 * p)}")
                                                              for i, p in enumerate(QUARTILES)], "max")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths between min and max, empty bins left out; the top edge is inside the last bin."""
    rows = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL")
    b = F.col(STATS)
    slot = F.when(b["lo"] == b["hi"], F.lit(1)).otherwise(
        F.least(F.width_bucket("x", b["lo"], b["hi"], F.lit(bins)), F.lit(bins))
    )
    return (
        with_stats(rows, rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
        .select(slot.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    )


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles, the most extreme values within 1.5 interquartile ranges, and the number outside."""
    q = F.col(STATS)[col]
    fences = with_stats(df.select(F.col(col).cast("double").alias("x")), quantile_row(df, {col: [0.25, 0.5, 0.75]})).select(
        "x", q.alias("q"), (q[0] - 1.5 * (q[2] - q[0])).alias("lo"), (q[2] + 1.5 * (q[2] - q[0])).alias("hi"))
    return fences.agg(
        F.first("q").alias("q"),  # the same on every row
        F.min(F.when(F.col("x") >= F.col("lo"), F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("x") <= F.col("hi"), F.col("x"))).alias("whisker_high"),
        F.count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("n_outliers"),
    ).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
             "whisker_low", "whisker_high", "n_outliers")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long-form Pearson matrix (a, b, corr) over the rows where both columns are known. One pass and one plan for any number
    of columns; NULL for pairs with a constant column or without rows."""
    return correlations(comoments(df, cols), cols)


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def minmax_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    x, b = F.col(col).cast("double"), F.col(STATS)
    bounded = with_stats(df, df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    return bounded.withColumn(out or col, (x - b["lo"]) / (b["hi"] - b["lo"] + F.lit(1e-9))).drop(STATS)


def quantile_tiers(
    df: DataFrame, score: str, probs: Sequence[float] = (0.0, 0.5, 0.8, 1.0),
    labels: Sequence[str] = ("Low", "Medium", "High"), out: str = "tier", approx: bool = False,
) -> DataFrame:
    """Name each score's quantile band; bands are closed on the right, the first on both sides.
    Equal cut points leave a band undefined and fail the query."""
    if len(labels) != len(probs) - 1:
        raise ValueError("need one label per band")
    q = F.col(STATS)[score]
    repeated = F.size(F.array_distinct(q)) < len(probs)
    band = F.when(F.col(score).isNull(), F.lit(None).cast("string")).when(
        repeated, F.raise_error(F.lit("quantile cut points are not unique"))
    )
    for i, label in enumerate(labels[:-1]):
        band = band.when(F.col(score) <= q[i + 1], F.lit(label))
    cut = with_stats(df, quantile_row(df, {score: list(probs)}, approx=approx))
    return cut.withColumn(out, band.otherwise(F.lit(labels[-1]))).drop(STATS)


# ---------------------------------------------------------------- per-key statistics

def user_stats(
    df: DataFrame, key: str, amount: str, devices: str | None = None, prefix: str = "user"
) -> DataFrame:
    """Mean amount, row count and largest device-change count per key, combined map-side. NULL is no key."""
    aggs = [F.avg(amount).alias(f"{prefix}_mean_order"), F.count(key).alias(f"{prefix}_order_count")]
    if devices and devices in df.columns:
        aggs.append(F.max(devices).alias(f"{prefix}_device_changes"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def attach_group_stats(
    df: DataFrame, key: str, amount: str, devices: str | None = None, stats_from: DataFrame | None = None
) -> DataFrame:
    """Left join of the per-key statistics. Spark broadcasts them when they turn out small;
    otherwise a hot key's rows are split by the adaptive skew join."""
    stats = user_stats(stats_from if stats_from is not None else df, key, amount, devices)
    return df.join(stats, key, "left")


def segment_risk(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Mean flag per segment, riskiest first. NULL is no segment."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(flag).cast("double")).alias("risk"), F.count("*").alias("n"))
        .orderBy(F.desc("risk"), F.asc(key))
    )


def members_only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed, each once however often the key is listed."""
    return df.join(keys.select(on), on, "left_semi")
