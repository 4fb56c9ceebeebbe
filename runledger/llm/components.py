"""Distributed connected components by alternating large-star and small-star
rounds.  Every round is two grouped minima and two joins over the edge table;
nothing of it is collected, and each round is stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("least", F.least("u", "least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = _least(edges)
    others = (edges.join(least, "u").filter("v != least")
              .select(F.col("v").alias("u"), F.col("least").alias("v")))
    return others.unionByName(least.withColumnRenamed("least", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node
    reachable.  Direction, repeats and loops don't matter; rows with a null end
    are no links.  An empty edge table gives no rows."""
    now = store(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = store(_small_star(_large_star(now)), "edges")
        drop_stored(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
