"""Feature preparation: imputation, scaling, encoding, capping and class weights.

Fitted statistics are small tables; applying them never shuffles the rows they are applied to
(scalar subqueries for whole-table statistics, joins against a per-category table otherwise).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .ordering import dense_codes, quantile_row
from .profile import STATS, with_stats

MAX_COLUMNS = 10_000


# ---------------------------------------------------------------- scaling

def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation per column."""
    return df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols
    ])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / std with statistics fitted elsewhere; a constant column becomes 0."""
    s = F.col(STATS)
    return with_stats(df, stats).withColumns({
        f"{c}{suffix}": (F.col(c) - s[c]["mean"]) / F.when(s[c]["std"] == 0, F.lit(1.0)).otherwise(s[c]["std"])
        for c in cols
    }).drop(STATS)


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    return apply_scaler(df, scaler_stats(df, cols), cols, suffix)


def winsorize(df: DataFrame, cols: Sequence[str], p: float = 0.99) -> DataFrame:
    """Cap every column above its own quantile; NULL stays NULL."""
    q = F.col(STATS)
    return with_stats(df, quantile_row(df, {c: [p] for c in cols})).withColumns({
        c: F.when(F.col(c) > q[c][0], q[c][0]).otherwise(F.col(c).cast("double")) for c in cols
    }).drop(STATS)


# ---------------------------------------------------------------- imputation

def mode_row(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value, the smallest one on ties. Counts are shuffled per value and only
    one candidate per task is kept, so no buffer grows with the number of values."""
    return (
        df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), F.asc(col)).limit(1).select(col)
    )


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
           fit_on: DataFrame | None = None) -> DataFrame:
    """Median for numeric NULLs (NaN counts as NULL), most frequent value for text NULLs."""
    source = fit_on if fit_on is not None else df
    filled = {c: F.coalesce(F.col(c), mode_row(source, c).scalar()) for c in categorical}
    if not numeric:
        return df.withColumns(filled)
    for c in numeric:
        known = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        filled[c] = F.coalesce(known, F.col(STATS)[c][0])
    return with_stats(df, quantile_row(source, {c: [0.5] for c in numeric})).withColumns(filled).drop(STATS)


# ---------------------------------------------------------------- encoding

def categories(df: DataFrame, col: str, limit: int = MAX_COLUMNS) -> list:
    """Sorted distinct values for encodings that make one column per value. The number of columns
    bounds what may be listed, so more than ``limit`` values are an error, not a truncation."""
    values = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{col} has more than {limit} values; use label_encode instead")
    return sorted(values)


def indicator_columns(df: DataFrame, col: str, values: Sequence, keep: bool = True) -> DataFrame:
    """One 0/1 column per listed value; any other value, and NULL, gives all zeros."""
    out = df.withColumns({
        f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)) for v in values
    })
    return out if keep else out.drop(col)


def one_hot_ignore(df: DataFrame, col: str, fit_on: DataFrame | None = None) -> DataFrame:
    return indicator_columns(df, col, categories(fit_on if fit_on is not None else df, col))


def dummies_drop_first(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Indicators for all but the first value in sorted order; the source column goes away."""
    source = fit_on if fit_on is not None else df
    for c in cols:
        df = indicator_columns(df, c, categories(source, c)[1:], keep=False)
    return df


def label_encode(df: DataFrame, col: str, out: str, codes: DataFrame | None = None,
                 unseen: str = "error") -> DataFrame:
    """Position of the value among the sorted distinct values.

    ``unseen='error'`` fails the query on a value the codes do not list; ``'null'`` leaves NULL.
    """
    codes = codes if codes is not None else dense_codes(df, col)
    table = small_side(codes.select(F.col("value").alias("_value"), F.col("code").alias(out)))
    joined = df.join(table, F.col(col) == F.col("_value"), "left").drop("_value")
    if unseen == "null":
        return joined
    return joined.withColumn(out, F.when(
        F.col(out).isNull() & F.col(col).isNotNull(),
        F.raise_error(F.concat(F.lit("unseen category: "), F.col(col).cast("string"))),
    ).otherwise(F.col(out)))


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Like :func:`label_encode` on the column itself, with -1 for NULL."""
    return label_encode(df, col, out, unseen="null").withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("bigint")))


# ---------------------------------------------------------------- imbalance

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class), so weights average to 1."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    t = F.col(STATS)
    total = with_stats(counts, counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")))
    return total.select(label, "n", (t["n"] / (t["k"] * F.col("n"))).alias("weight"))


def attach_class_weights(df: DataFrame, label: str, fit_on: DataFrame | None = None, out: str = "weight") -> DataFrame:
    weights = class_weights(fit_on if fit_on is not None else df, label)
    return df.join(small_side(weights.select(label, F.col("weight").alias(out))), label, "left")


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive; NULL when there is no positive."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(neg.alias("negatives"), pos.alias("positives"),
                  F.try_divide(neg, pos).alias("pos_weight"))


# ---------------------------------------------------------------- schema-tolerant order features

# Keys, labels and raw times that are not features of an order.
NOT_FEATURES = ["order_id", "user_id", "product_id", "order_date", "fraud_prob_sim", "is_fraud"]


def order_fraud_features(
    df: DataFrame, stats_from: DataFrame | None = None, encode: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Behavioural features of web orders; a step is skipped when its columns are absent.

    Per-user statistics come from all rows unless ``stats_from`` names the training rows.
    """
    from ..functions import columns as C
    from .profile import attach_group_stats

    cols = set(df.columns)

    def have(*names: str) -> bool:
        return cols.issuperset(names)

    if have("order_date") and dict(df.dtypes)["order_date"] == "string":
        df = df.withColumn("order_date", C.parse_time("order_date"))
    if have("user_id", "order_amount"):
        df = attach_group_stats(df, "user_id", "order_amount", "device_change_count", stats_from)
        df = df.withColumn("order_value_deviation", C.relative_deviation("order_amount", "user_mean_order"))
    if have("order_date"):
        df = df.withColumns({"order_hour": C.hour_of("order_date"), "order_weekday": C.weekday_of("order_date")})
    df = df.withColumn(
        "high_device_change",
        C.threshold_flag("device_change_count", 2) if have("device_change_count") else F.lit(0))
    df = df.withColumn("high_velocity", C.velocity_flag(
        F.col("recent_orders_1day") if have("recent_orders_1day") else None,
        F.col("recent_orders_1hr") if have("recent_orders_1hr") else None))
    present = [c for c in ("billing_region", "shipping_region", "device_type", "payment_type") if c in cols]
    if encode is None:
        return dummies_drop_first(df, present, stats_from)
    for c in present:  # categories fixed when the model was fitted
        df = indicator_columns(df, c, encode[c], keep=False)
    return df
