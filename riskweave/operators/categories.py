"""Category columns as one sparse vector, for any number of categories.

A dictionary gives every (column, value) pair a slot. It is a table, kept as Parquet between runs, never a list on the
driver; a million categories are a million lines. Encoding joins each column with its part of the dictionary: values that
many rows share are looked up in a broadcast part of proven size, all others are shuffled, so no value gathers its rows in one
task. A value that the dictionary does not list, and NULL, leave their column all zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordering import running_totals

FREQUENT = 1000  # a value on more than one row in so many is frequent; hence there are fewer of them per column than this
DICTIONARY = "column string, value string, slot bigint, frequent boolean"
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) over all columns in one pass; a value's rows combine before they are shuffled."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")
    return df.select(pairs).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def _numbered(counts: DataFrame, cols: Sequence[str], start: int, rows: int) -> DataFrame:
    """Slots from ``start`` on, by the place of the column and by the value."""
    place = F.coalesce(*[F.when(F.col("column") == c, F.lit(i)) for i, c in enumerate(cols)])
    lines = materialize(counts.select(place.alias("place"), "column", "value", "n", F.lit(1).cast("bigint").alias("one")))
    order = [F.col("place"), F.col("value")]
    return running_totals(lines, order, {"upto": "one"}, lines.count()).select(
        "column", "value", (F.col("upto") + (start - 1)).alias("slot"), (F.col("n") * FREQUENT > rows).alias("frequent"))


def fit_categories(df: DataFrame, cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """The dictionary (column, value, slot, frequent) of the non-NULL values, compared as text.

    Slots follow the order of ``cols`` and the values' order. ``drop_first`` leaves out the smallest value of every column,
    whose rows then are all zero. An empty table gives an empty dictionary.
    """
    counts = _counts(df, cols)
    if drop_first:
        counts = materialize(counts)
        least = counts.groupBy("column").agg(F.min("value").alias("value"))  # a line per column
        counts = counts.join(F.broadcast(least), ["column", "value"], "left_anti")
    return _numbered(counts, cols, 0, df.count())


def extend_categories(dictionary: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The dictionary with the values that only ``df`` holds behind it. Old slots stay, so vectors made before remain valid.
    Which values are frequent is told anew, from ``df``, since it only steers how rows meet the dictionary."""
    rows, counts = df.count(), materialize(_counts(df, cols))
    start = dictionary.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    fresh = counts.join(dictionary.select("column", "value"), ["column", "value"], "left_anti")
    often = counts.where(F.col("n") * FREQUENT > rows).select("column", "value", F.lit(True).alias("often"))
    old = dictionary.join(often, ["column", "value"], "left").select(
        "column", "value", "slot", F.coalesce("often", F.lit(False)).alias("frequent"))
    return old.unionByName(_numbered(fresh, cols, start, rows))


def save_categories(dictionary: DataFrame, path: str) -> None:
    dictionary.write.partitionBy("column").parquet(path)


def load_categories(spark, path: str) -> DataFrame:
    """The stored dictionary; a lookup reads only its column's folder."""
    return spark.read.schema(DICTIONARY).parquet(path)


def _with_slot(df: DataFrame, part: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the slot of ``col``. The frequent values come by broadcast. Their rows, and those without a value, go through the
    shuffle under a hash of the row, so that it does not bring them together."""
    often = part.where("frequent").select(F.col("value").alias("_often"), F.col("slot").alias("_near"))
    rare = part.where("NOT frequent").select(F.col("value").alias("_rare"), F.col("slot").alias("_far"), F.lit(0).alias("_at"))
    value = F.col(col).cast("string")
    rows = df.join(F.broadcast(often), value == F.col("_often"), "left")  # fewer than FREQUENT lines
    settled = F.col("_near").isNotNull() | F.col(col).isNull()
    rows = rows.withColumn("_mine", F.coalesce(value, F.lit(""))).withColumn(
        "_spread", F.when(settled, F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) + 1).otherwise(0).cast("int"))
    rows = rows.join(rare, (F.col("_mine") == F.col("_rare")) & (F.col("_spread") == F.col("_at")), "left")
    return rows.select(*df.columns, F.coalesce("_near", "_far").alias(out))


def encode_categories(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], out: str = "features",
                      numeric: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``: type, size, indices and values as Spark ML lays out a sparse vector.

    Numeric columns, if any, take the slots in front (0 is left out, NULL becomes NaN); every known category is a 1. The
    size is that of the dictionary, however few slots a row uses.
    """
    front = len(numeric)
    size = dictionary.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0] + front
    if size > 2**31 - 1:
        raise ValueError("a sparse vector has 32-bit slots")
    slots = [f"_slot_{i}" for i in range(len(cols))]
    rows = df
    for c, s in zip(cols, slots):
        rows = _with_slot(rows, dictionary.where(F.col("column") == c), c, s)
    cell = "struct<i:int,v:double>"
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    cells = [F.when(amount(c) != 0, F.struct(F.lit(i).alias("i"), amount(c).alias("v"))) for i, c in enumerate(numeric)] + [
        F.when(F.col(s).isNotNull(), F.struct((F.col(s) + front).cast("int").alias("i"), F.lit(1.0).alias("v"))) for s in slots]
    filled = F.array_sort(F.array_compact(F.array(*[c.cast(cell) for c in cells])))
    return rows.withColumn("_filled", filled).select(*df.columns, F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.transform("_filled", lambda e: e["i"]).alias("indices"), F.transform("_filled", lambda e: e["v"]).alias("values"),
    ).cast(SPARSE).alias(out))


def as_vectors(df: DataFrame, path: str, col: str = "features") -> DataFrame:
    """The rows with ``col`` as Spark ML vectors: written once as Parquet and read under the vector type, which has the same
    layout there. No row passes through Python."""
    df.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def category_frequencies(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, slot, n): how often each listed value occurs in ``df``, 0 included."""
    return dictionary.join(_counts(df, cols), ["column", "value"], "left").select(
        "column", "value", "slot", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
