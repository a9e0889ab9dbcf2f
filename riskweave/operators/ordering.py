"""Global order on a cluster: running totals, exact quantiles and dense codes.

A window without PARTITION BY moves a whole table into one task. The helpers here use such a
window only over tables whose size was checked first; beyond the limit they range-partition the
rows, total each range, and add the totals of the earlier ranges.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sketches import exact_quantiles

SINGLE_TASK_ROWS = 1_000_000


def approx_distinct(df: DataFrame, col: str) -> int:
    """One map-side combined pass that holds only sketches."""
    return df.agg(F.approx_count_distinct(col).alias("n")).first()["n"]


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, str],
    approx_rows: int,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add an inclusive running sum of column ``c`` as ``name`` for every ``name: c`` in ``sums``.

    ``order`` must be unique per row (aggregate first, so a value shared by a third of all rows is
    one row here). ``approx_rows`` is the checked size of ``df``.
    """
    if approx_rows <= single_task_rows:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(w).alias(name) for name, c in sums.items()])

    parts = math.ceil(2 * approx_rows / single_task_rows)
    # Range bounds come from sampling, so they are fixed by writing the result once.
    ranged = materialize(
        df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(offsets), "_range")  # as many rows as ranges
        .select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()])
    )


# ---------------------------------------------------------------- quantiles

BUFFER_VALUES = 50_000


def quantile_row(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    buffer_values: int = BUFFER_VALUES,
    single_task_rows: int = SINGLE_TASK_ROWS,
    approx: bool = False,
) -> DataFrame:
    """One row with an array of linearly interpolated quantiles per column; NULL and NaN are left out.

    The built-in exact aggregate keeps every distinct value in one buffer, so it is used only for
    columns whose distinct count was checked. The others go through :func:`exact_quantiles`.
    ``approx=True`` reads everything from sketches.
    """
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in probs])
    if approx:
        return x.agg(*[F.percentile_approx(c, [float(p) for p in ps], 100_000).alias(c) for c, ps in probs.items()])
    sizes = x.agg(*[F.approx_count_distinct(c).alias(c) for c in probs]).first()
    large = {c: ps for c, ps in probs.items() if sizes[c] > buffer_values}
    known = exact_quantiles(x, large, single_task_rows=single_task_rows) if large else {}
    cells = {
        c: F.array(*[F.lit(v) for v in known[c]]) if c in known
        else F.percentile(c, F.array(*[F.lit(float(p)) for p in ps]))
        for c, ps in probs.items()
    }
    computed = [cells[c].alias(c) for c in probs if c not in known]
    base = x.agg(*computed) if computed else df.sparkSession.range(1)
    return base.select(*[cells[c].alias(c) if c in known else F.col(c) for c in probs])


# ---------------------------------------------------------------- dense codes

def dense_codes(df: DataFrame, col: str, start: int = 0, max_values: int = SINGLE_TASK_ROWS) -> DataFrame:
    """(value, code): the distinct non-NULL values in sorted order, numbered from ``start``."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    numbered = running_totals(
        values.withColumn("_one", F.lit(1).cast("bigint")), [F.col("value")], {"code": "_one"},
        approx_distinct(df, col), max_values,
    )
    return numbered.select("value", (F.col("code") - 1 + start).cast("bigint").alias("code"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of an order; Spark keeps only ``k`` rows per task on the way."""
    return df.orderBy(*order).limit(k)


def top_k_by_abs(df: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    return top_k(df, k, F.abs(value).desc(), F.col(name).asc())
