"""Readers and writers. Schemas are given, so no pass over the data is spent on guessing them."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CARD_TRANSACTIONS = (
    "TransactionID string, Timestamp timestamp_ntz, Amount double, MerchantCategory string, PaymentMethod string, "
    "NewDeviceFlag int, Country string, AvgTxSize double, TxFrequency int, Fraudulent int"
)
STORED_ANSWERS = "`Question` string, `Model Response` string, `Label (Fill later)` string"

# Leading bytes of the image formats accepted as intact.
IMAGE_STARTS = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D"}


# A missing value is an empty field without quotes, an empty text one with quotes. Spark takes both for
# missing as long as the empty text itself stands for a missing value, so the readers name one that no file holds.
NO_TEXT = "\x00"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", NO_TEXT).csv(path)


def read_csv_multiline(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Quoted values may span lines. Such a file cannot be split, so keep one to a moderate size
    and give many files for many rows."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option(
        "nullValue", NO_TEXT).csv(path)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes inside values are doubled, so the readers above get back what was written."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame, out: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(out))


def write_report(blocks: DataFrame, path: str, column: str = "block") -> None:
    blocks.select(column).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- validity

def quarantine_invalid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad); a row whose check is unknown is bad. Nothing is deleted."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def quarantine_counts(df: DataFrame, folder: Column, valid: Column) -> DataFrame:
    """Good and bad rows per folder in one pass."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(folder.alias("folder")).agg(F.count_if(ok).alias("n_good"), F.count_if(~ok).alias("n_bad"))


def looks_like_image(content: Column) -> Column:
    """Known leading bytes and, for the formats that have one, the closing marker."""
    def starts(kind: str) -> Column:
        mark = IMAGE_STARTS[kind]
        return F.hex(F.substring(content, 1, len(mark) // 2)) == mark

    def ends(mark: str) -> Column:
        n = len(mark) // 2
        return F.hex(F.substring(content, -n, n)) == mark

    return ((starts("jpeg") & ends("FFD9")) | (starts("png") & ends("AE426082"))
            | (starts("gif") & ends("3B")) | starts("bmp"))


def labelled_files(spark: SparkSession, path: str, frac: float = 0.2, seed: int = 123) -> DataFrame:
    """One row per file with its folder as label and a repeatable train/validation mark. The draw
    hashes folder and file name, so the mark does not change when the tree is moved."""
    from ..functions.columns import hash_int

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    # Spark lists empty files but gives them no task, so they are put back from its own listing.
    listed = [(re.sub(r"^(\w+):///", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    files = files.unionByName(empty.select("path", F.lit(b"").alias("content")))
    parts = F.split("path", "/")
    name = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return files.select(
        "path", "content", F.element_at(parts, -2).alias("folder"),
        F.when(hash_int(name, seed=seed) < F.lit(round(frac * 4294967296)), F.lit("validation"))
        .otherwise(F.lit("training")).alias("subset"))
