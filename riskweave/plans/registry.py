"""Query registry: a name, the Spark plan and, where one exists, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The parquet tables of one folder, read on demand so plans prune columns and push filters."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``plan(tables)`` under ``name``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = (lambda spark, folder: plan(Tables(spark, folder)), sql)
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for name, (plan, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def hash_sql(key: str, seed: object, digits: int = 8) -> str:
    """SQL twin of ``hash_int``; with 15 digits of ``hash_long``."""
    return f"('0x' || substr(md5({key} || ':{seed}'), 1, {digits}))::BIGINT"
