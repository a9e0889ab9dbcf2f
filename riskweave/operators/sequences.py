"""Per-key sequences: sliding windows with a next-step label, and velocity counts.

One key may hold a large share of the table. The rows of such keys are cut into slices of a bounded number of rows, at
order statistics of key and order that Spark's range partitioning draws. Every slice is windowed on its own and receives
the few values it needs from the slices before it, so no task has to hold a whole key, however its rows bunch in time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros_of
from ..session import materialize, small_side

KEY_ROWS = 1_000_000  # rows of one key that one task may order
FRAME_ROWS = 10_000  # rows of one key over which a sliding frame may be added up per row
SLICE_ROWS = 500_000  # rows of a slice of busy keys, on average


def split_by_key_size(
    df: DataFrame, key: str, key_rows: int,
    light: Callable[[DataFrame], DataFrame], heavy: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """Apply ``light`` to keys of at most ``key_rows`` rows and ``heavy``, which is told the number of rows, to the others.

    The count combines map-side. Heavy keys are few (rows / key_rows at most); they are written
    once so both branches agree on them, and Spark picks the join from their actual size.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > key_rows)
    if not counts.take(1):
        return light(df)
    hot = materialize(counts)
    rows = hot.agg(F.sum("_n")).first()[0]
    hot = hot.select(key)
    return light(df.join(hot, key, "left_anti")).unionByName(heavy(df.join(hot, key, "left_semi"), rows))


def cut_by_rows(df: DataFrame, key: str, order: Sequence[str], rows: int, slice_rows: int) -> DataFrame:
    """Add ``_slice``: numbers that grow along ``key`` and ``order``, each on about ``slice_rows`` of the ``rows`` rows.

    The bounds come from a sample, so the result is written once and every later stage sees the same slices.
    """
    parts = max(1, math.ceil(rows / slice_rows))
    return materialize(df.repartitionByRange(parts, key, *order).withColumn("_slice", F.spark_partition_id()))


def sliding_sequences(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    features: Mapping[str, Column],
    length: int = 6,
    key_rows: int = KEY_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every run of ``length`` consecutive rows of a key that is followed by another row.

    The row after the run is the output row; its own columns stay available for the label, and
    ``seq`` holds the run in order. Keys with at most ``length`` rows give nothing.

    ``order`` has to tell the rows of a key apart. Keys beyond ``key_rows`` rows are cut into slices of about
    ``slice_rows`` rows. Rows without a key belong to no sequence.
    """
    df = df.where(F.col(key).isNotNull())
    return split_by_key_size(
        df, key, key_rows,
        lambda d: _slide(d, df.columns, key, order, features, length, False),
        lambda d, rows: _slide(cut_by_rows(d, key, order, rows, slice_rows), df.columns, key, order, features, length, True),
    )


def _slide(df, columns, key, order, features, length, sliced) -> DataFrame:
    rows = df.withColumn("_cell", F.struct(*[c.alias(n) for n, c in features.items()]))
    group = [key, "_slice"] if sliced else [key]
    inside = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("_here", F.collect_list("_cell").over(inside.rowsBetween(-length, -1)))
    if sliced:
        # Last cells of every slice, then the last cells of all earlier slices of the key.
        ends = (
            df.withColumn("_cell", F.struct(*[c.alias(n) for n, c in features.items()]))
            .select(*group, *order, "_cell")
            .withColumn("_back", F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(o).desc() for o in order])))
            .where(F.col("_back") <= length)
            .groupBy(*group)
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), F.col("_cell").alias("c")))).alias("l"))
            .select(*group, F.transform("l", lambda e: e["c"]).alias("_tail"))
        )
        # A slice holds at least one row of the key, so `length` earlier slices hold every cell needed.
        earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(-length, -1)
        carried = ends.select(*group, F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
        rows = rows.join(small_side(carried), group).withColumn("_here", F.concat("_carry", "_here"))
    return (
        rows.where(F.size("_here") >= length)
        .withColumn("seq", F.slice("_here", -length, length))
        .select(*columns, "seq")
    )


def next_step_label(on_time: Column) -> Column:
    """0 when the step after the run was on time, else 1 (also when it is unknown)."""
    return F.when(F.coalesce(on_time.cast("int"), F.lit(0)) == 1, F.lit(0)).otherwise(F.lit(1))


def min_history(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Keep non-NULL keys with at least ``rows`` rows: counts combine map-side, then a semi join."""
    enough = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= rows)
    return df.join(enough, key, "left_semi")


def mask_steps(seq: Column | str, fields: Sequence[str]) -> Column:
    """Drop steps in which every feature is 0."""
    seq = F.col(seq) if isinstance(seq, str) else seq

    def live(step: Column) -> Column:
        cond = step[fields[0]] != 0
        for f in fields[1:]:
            cond = cond | (step[f] != 0)
        return cond

    return F.filter(seq, live)


def flatten_steps(seq: Column | str, fields: Sequence[str]) -> Column:
    """One flat ``array<double>``: the features of step 1, then of step 2, and so on."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.flatten(F.transform(seq, lambda s: F.array(*[s[f].cast("double") for f in fields])))


def velocity_counts(
    df: DataFrame, key: str, ts: str, horizons: Mapping[str, int], key_rows: int = FRAME_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """For each row, the rows of its key in the last ``seconds`` up to and including its instant,
    as one column per ``name: seconds`` in ``horizons``. NULL keys or times give NULL counts.

    Spark adds a sliding frame up again for every row, so its cost grows with the square of a busy
    key. Keys beyond ``key_rows`` rows are counted by differences of running counts instead.
    """
    micros = micros_of(ts, dict(df.dtypes)[ts] == "timestamp")

    def ranged(d: DataFrame) -> DataFrame:
        # Rows without a key need no frame; a hash keeps them from meeting in one task.
        spread = F.when(F.col(key).isNull(), F.xxhash64(*d.columns))
        per_key = Window.partitionBy(key, spread).orderBy(micros)
        known = F.col(ts).isNotNull() & F.col(key).isNotNull()
        return d.select("*", *[
            F.when(known, F.count("*").over(per_key.rangeBetween(-s * 1_000_000, 0))).alias(name)
            for name, s in horizons.items()
        ])

    return split_by_key_size(
        df, key, key_rows, ranged, lambda d, rows: _running_counts(d.withColumn("_t", micros), key, horizons, rows, slice_rows))


def _running_counts(df: DataFrame, key: str, horizons: Mapping[str, int], rows: int, slice_rows: int) -> DataFrame:
    """The same counts for keys too big for one task; ``_t`` is the instant in microseconds.

    Rows of one instant are counted first, so a burst is one line. Every line enters the running count at its instant and
    leaves that of horizon ``h`` right after ``instant + h``; a count is what has entered less what has left. The running
    counts are added up per slice, with the totals of the key's earlier slices in front.
    """
    kinds = range(1, len(horizons) + 1)
    dated, undated = df.where("_t IS NOT NULL"), df.where("_t IS NULL")
    moments = dated.groupBy(F.col(key).alias("_key"), "_t").agg(F.count("*").alias("n"))
    # Entering sorts before leaving, so what lies exactly `h` back still counts.
    moves = [F.struct(F.col("_t").alias("t"), F.lit(0).alias("kind"))] + [
        F.struct((F.col("_t") + F.lit(s * 1_000_000)).alias("t"), F.lit(h).alias("kind"))
        for h, s in zip(kinds, horizons.values())]
    steps = moments.select("_key", "n", F.explode(F.array(*moves)).alias("m")).select("_key", "n", "m.t", "m.kind")
    cut = cut_by_rows(steps, "_key", ["t", "kind"], rows * len(moves), slice_rows)

    def moved(kind: int) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(F.lit(0)))

    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_key", "_slice").agg(*[moved(k).alias(f"_all_{k}") for k in (0, *kinds)])
    fronts = totals.select("_key", "_slice", *[
        F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_front_{k}") for k in (0, *kinds)])
    inside = Window.partitionBy("_key", "_slice").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.select("*", *[moved(k).over(inside).alias(f"_run_{k}") for k in (0, *kinds)]).where("kind = 0")
    counted = materialize(run.join(small_side(fronts), ["_key", "_slice"]).select(
        "_key", F.col("t").alias("_moment"), F.col("n").alias("_n"),
        *[(F.col("_run_0") + F.col("_front_0") - F.col(f"_run_{k}") - F.col(f"_front_{k}")).alias(name)
          for k, name in zip(kinds, horizons)]))

    def attach(d: DataFrame, counts: DataFrame) -> DataFrame:
        hit = (F.col(key) == F.col("_key")) & (F.col("_t") == F.col("_moment"))
        return d.join(counts.drop("_n"), hit).drop("_key", "_moment", "_t")

    # Moments that hold more rows than a slice are at most rows / slice_rows lines; their rows stay where they lie.
    bursts = counted.where(F.col("_n") > slice_rows)
    if bursts.isEmpty():
        done = attach(dated, counted)
    else:
        bursts = small_side(bursts)
        at = (F.col(key) == F.col("_key")) & (F.col("_t") == F.col("_moment"))
        done = attach(dated, bursts).unionByName(
            attach(dated.join(bursts, at, "left_anti"), counted.where(F.col("_n") <= slice_rows)))
    return done.unionByName(undated.drop("_t").withColumns({name: F.lit(None).cast("bigint") for name in horizons}))
