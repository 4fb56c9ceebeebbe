"""Ranks over a whole table without a window over it: rows are range-sorted
and stored, and a row's rank is its place in its part plus the rows of the
parts before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store


def ranked(df: DataFrame, order: list[Column], within: str | None = None) -> DataFrame:
    """``df`` stored, with ``rank`` (long, from 1) in the order given; inside
    each value of ``within`` (a column without nulls, ordered first) where it
    is named.  Rows equal in ``order`` are parted by their place in the scan,
    so no group of equal rows has to fit one task.  A hot value of ``within``
    spreads over as many parts as its rows need; the table of counts has a row
    per part and value that meet."""
    order = [*([F.col(within)] if within else []), *order]
    sort = [*order, F.col("_scan")]
    spread = df.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = store(spread.withColumn("_at", F.monotonically_increasing_id()).drop("_scan"), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    key = ["_part", *([within] if within else [])]
    counts = placed.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # the window sees one row per part (of one value), never the rows themselves
    earlier = (Window.partitionBy(within) if within else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = store(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "parts")
    return (placed.join(before, key)
            .withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1)
            .drop("_part", "_at", "_n", "_first", "_before"))
