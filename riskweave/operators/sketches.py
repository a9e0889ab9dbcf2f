"""Profiles that can be stored, merged and read without the rows, and exact order statistics found with their help.

A profile has a row per column (and part): rows, missing ones, mean, squared deviation, extremes and a quantile sketch. Those
of parts add up to that of the whole, so a new part costs a pass over that part alone.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SKETCH = 8192  # values kept per level: ranks are off by about 5e-4, in a few of a hundred cases more
MARGIN = 2e-3


def known(col: str) -> Column:
    """A column as double; NaN is missing."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def profile_parts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), size: int = SKETCH) -> DataFrame:
    """(by..., column, n_rows, n, mean, dev, min, max, sketch) in one pass. NULL and NaN are missing; a column without values
    has n = 0 and no sketch. Parts are the values of ``by``, NULL among them."""
    x = df.select(*by, *[known(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    cells = [
        F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                 (F.var_pop(v) * F.count(v)).alias("dev"), F.min(v).alias("min"), F.max(v).alias("max"),
                 F.kll_sketch_agg_double(v, size).alias("sketch")).alias(v)
        for i, c in enumerate(cols) for v in [f"_x{i}"]
    ]
    one = x.groupBy(*by).agg(*cells) if by else x.agg(*cells)
    out = one.select(*by, F.explode(F.array(*[F.col(f"_x{i}") for i in range(len(cols))])).alias("p"))
    return out.select(*by, "p.*").withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merge_profiles(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of parts as one per column (and value of ``by``). Deviations are moved to the common mean before they are
    added, so no digits are lost where means are large."""
    keys = [*by, "column"]
    totals = parts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    moved = parts.join(totals, on=[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    shift = F.col("mean") - F.col("_mean")
    return moved.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.first("_mean").alias("mean"),  # the same on every row
        F.sum(F.col("dev") + F.col("n") * shift * shift).alias("dev"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch")).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def described(profiles: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What a profile tells without the rows: (column, n_rows, n, mean, std, min, quantiles, max). Quantiles are values of the
    sketch, within about 5e-4 of their rank."""
    quantiles = F.when(F.col("n") > 0, F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs]))
    return profiles.withColumns({"quantiles": quantiles, "std": F.sqrt(F.try_divide(F.col("dev"), F.col("n") - 1))}).select(
        *[c for c in profiles.columns if c not in ("dev", "sketch", "mean", "min", "max")], "mean", "std", "min", "quantiles", "max")


# ---------------------------------------------------------------- exact order statistics

def _edges(profiles: DataFrame, wanted: Sequence[tuple[str, float]], margins: Sequence[float]) -> dict[str, list]:
    """Per column the sketch's values around each wanted rank."""
    points = sorted({min(max(p + d * m, 0.0), 1.0) for (_, p), m in zip(wanted, margins) for d in (-1, 1)})
    at = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in points])
    rows = profiles.where("n > 0").select("column", at.alias("at")).collect()  # one row per column
    return {r["column"]: dict(zip(points, r["at"])) for r in rows}


def _split_counts(x: DataFrame, brackets: Sequence[tuple[str, float, float]]) -> DataFrame:
    """(b, v, c): rows per bracket and value inside it, and with v NULL the rows below. Tasks count equal values of a batch
    first, so what is shuffled grows with the values inside the brackets alone."""
    fixed = list(brackets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [0] * len(fixed)
        for batch in batches:
            values = {}
            for b, (col, lo, hi) in enumerate(fixed):
                if col not in values:
                    values[col] = batch.column(col).drop_null().to_numpy(zero_copy_only=False)
                v = values[col]
                below[b] += int((v < lo).sum())
                inside, c = np.unique(v[(v >= lo) & (v <= hi)], return_counts=True)
                if len(c):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c), b, np.int32)), pa.array(inside), pa.array(c)], ["b", "v", "c"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(fixed)), pa.int32()), pa.nulls(len(fixed), pa.float64()), pa.array(below, pa.int64())], ["b", "v", "c"])

    return x.mapInArrow(count, "b int, v double, c bigint").groupBy("b", "v").agg(F.sum("c").alias("c"))


def exact_quantiles(
    df: DataFrame, probs: Mapping[str, Sequence[float]], profiles: DataFrame | None = None, single_task_rows: int = 1_000_000,
    margin: float = MARGIN,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, exact whatever the sketch was worth; None for a column without values.

    The sketch says between which values a rank should lie. One pass counts the rows below and gathers the values between; if
    the rank is not there, which the counts tell, the search is repeated eight times as wide.
    """
    from .ordering import running_totals

    cols = list(probs)
    if profiles is None:
        profiles = materialize(profile_parts(df, cols))
    sizes = {r["column"]: r["n"] for r in profiles.select("column", "n").collect()}
    x = df.select(*[known(c).alias(c) for c in cols])
    wanted = [(c, float(p)) for c in cols for p in probs[c]]
    found: dict[tuple[str, float], float | None] = {w: None for w in wanted}
    open_ = [w for w in dict.fromkeys(wanted) if sizes[w[0]]]
    while open_:
        margins = [margin + 2 / sizes[c] for c, _ in open_]
        edges = _edges(profiles, open_, margins)
        brackets = []
        for (c, p), m in zip(open_, margins):
            lo = -math.inf if p - m <= 0 else edges[c][p - m]
            hi = math.inf if p + m >= 1 else edges[c][p + m]
            brackets.append((c, lo, hi))
        counts = materialize(_split_counts(x, brackets))
        totals = {r["b"]: (r["below"], r["inside"], r["values"]) for r in counts.groupBy("b").agg(
            F.sum(F.when(F.col("v").isNull(), F.col("c"))).alias("below"), F.count("v").alias("values"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("inside")).collect()}
        ranks = [(sizes[c] - 1) * p for c, p in open_]
        hit = {b for b, r in enumerate(ranks) if totals[b][0] <= math.floor(r) and math.ceil(r) < totals[b][0] + totals[b][1]}
        picks, start = [], 0
        for b, r in enumerate(ranks):
            for step in (0, 1):
                rank = start + min(math.floor(r) + step, math.ceil(r)) - totals[b][0]
                picks.append(F.min(F.when((F.col("b") == b) & (F.col("upto") > F.lit(rank)), F.col("v"))).alias(f"q{b}_{step}"))
            start += totals[b][1]
        inside = counts.where("v IS NOT NULL")
        run = running_totals(inside, [F.col("b"), F.col("v")], {"upto": "c"}, sum(t[2] for t in totals.values()), single_task_rows)
        row = run.agg(*picks).first()
        for b in hit:
            low, high, share = row[f"q{b}_0"], row[f"q{b}_1"], ranks[b] - math.floor(ranks[b])
            found[open_[b]] = low if low == high else low + (high - low) * share
        open_, margin = [w for b, w in enumerate(open_) if b not in hit], margin * 8
    return {c: [found[c, float(p)] for p in probs[c]] for c in cols}


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
