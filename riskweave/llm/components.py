"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import attach_groups


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, both long); root is the component's smallest node.

    A round links every node's larger neighbours to the smallest one around, and then its smaller ones; this ends after
    a number of rounds that grows with the logarithm of the nodes. Rounds are written to the shared folder. Nodes with
    very many neighbours have their smallest neighbour broadcast, so no task gathers their edges. Null nodes, loops and
    repeated edges are ignored; no edges give no rows.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, now = None, _state(edges)
    while now != seen and now[0]:
        seen = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_least(both, least, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        down = _with_least(large, least, 2 * seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(down.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    key = F.col("a").cast("string")
    return attach_groups(edges.withColumn("_a", key), least.select(key.alias("_a"), "n", "m"), "_a", "n", n_rows, "b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
