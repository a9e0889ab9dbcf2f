"""Session settings and the few helpers that touch cluster-wide state."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def local_session(cpus: int | str = 8, app: str = "riskweave") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temp folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="riskweave-")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage, so a lost executor cannot
    make a later stage see other partition ids or another sample than an earlier one did."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """The side of a join that is expected to be small, ready to be broadcast once that is checked.

    Left to itself, a join against an aggregate writes the large side to shuffle files before the
    other side turns out to be tiny. At most ``max_rows + 1`` rows are fetched here; a larger table
    is returned as it was, for Spark to join by shuffling.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return broadcast(df.sparkSession.createDataFrame(rows, df.schema))


@contextmanager
def cached(*dfs: DataFrame) -> Iterator[None]:
    """Keep frames for the repeated passes of a fit, and let go of them afterwards."""
    for df in dfs:
        df.persist()
    try:
        yield
    finally:
        for df in dfs:
            df.unpersist()
