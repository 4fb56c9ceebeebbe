"""Dense surrogate ids for bulk inserts (W-4) without a global window.

``row_number() OVER (ORDER BY k)`` with no partition sends every row to one
task.  Instead: sort (range-partitioned, so the sort is spread over all
tasks), tag every row with its partition and position, count rows per
partition, and add the running total of the earlier partitions.  The count
table has one row per partition, which is the bound that lets it be
broadcast.  The tagged frame is checkpointed to the shared checkpoint folder
so the counting pass and the numbering pass see the same rows in the same
places even if tasks are retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def assign_ids(df: DataFrame, order_cols: list[str], start, id_col: str = "id") -> DataFrame:
    """Ids ``start + 1, start + 2, ...`` in ``order_cols`` order.

    ``start`` is a Python int or a one-value aggregate computed by the
    caller (e.g. the current max id)."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order_cols)
              .withColumn("_p", F.spark_partition_id())
              .withColumn("_m", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_p")       # one row per partition
            .withColumn(id_col, (F.lit(start) + F.col("_off") + (F.col("_m") - F.col("_m0")) + 1).cast("long"))
            .drop("_p", "_m", "_m0", "_off"))
