"""Connected components of a link table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Each round hooks the neighbours of every node to the least of them, first the larger
    neighbours, then the smaller ones, so the depth of the trees falls logarithmically. Rounds
    are written to the shared folder; only a row count and a checksum reach the driver. Links
    of a node to itself and repeated links have no effect; no links give an empty table.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(pairs.distinct())
    seen = _state(now)
    while seen[0]:
        after = materialize(_small_star(_large_star(now)))
        state = _state(after)
        discard(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
