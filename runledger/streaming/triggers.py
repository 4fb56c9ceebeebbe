"""T-3 / T-4: streaming metric triggers and trigger debounce.

Each batch is reduced by key in the JVM first (a hot key leaves a task as one
row), then compared with what earlier batches fired.  Batches write their own
``batch_id=k`` folder, so a replayed batch rewrites its rows and never doubles
them.  What fired is the only memory, and it is the trigger table itself; no
watermark can drop a late trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discovery import _read_or_empty, _write_batch

METRIC_SINK_SCHEMA = "run_id long, node_id long, metric_name string, agg_value double, batch_id long"
FIRED_SCHEMA = "run_id long, node_id long, metric_name string, metric_value double, message string, batch_id long"


def _start(stream, sink, checkpoint: str, available_now: bool):
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def metric_max_stream(metrics_stream: DataFrame, sink_path: str, checkpoint: str,
                      available_now: bool = True):
    """Running max per (run, node, metric): every batch writes the max of each
    group it saw; ``latest_values`` folds the batches."""
    def sink(batch: DataFrame, batch_id: int):
        _write_batch(batch.groupBy("run_id", "node_id", "metric_name").agg(F.max("metric_value").alias("agg_value"))
                     .withColumn("batch_id", F.lit(batch_id).cast("long")), sink_path)

    return _start(metrics_stream, sink, checkpoint, available_now)


def latest_values(updates: DataFrame, keys: list[str], value: str = "agg_value") -> DataFrame:
    """The running max after the last batch, per key."""
    return updates.groupBy(*keys).agg(F.max(value).alias(value))


def metric_trigger_stream(metrics_stream: DataFrame, sink_path: str, checkpoint: str, threshold: float,
                          available_now: bool = True):
    """One trigger row per (run, node, metric), written by the first batch that
    holds a value strictly above ``threshold``."""
    keys = ["run_id", "node_id", "metric_name"]

    def sink(batch: DataFrame, batch_id: int):
        over = batch.where(F.col("metric_value") > threshold).groupBy(*keys).agg(F.max("metric_value").alias("metric_value"))
        _write_batch(_not_yet(over, sink_path, FIRED_SCHEMA, keys, batch_id).withColumn(
            "message", F.concat(F.lit("max("), "metric_name", F.lit(f") > {threshold}"))), sink_path)

    return _start(metrics_stream, sink, checkpoint, available_now)


def _not_yet(rows: DataFrame, sink_path: str, schema: str, keys: list[str], batch_id: int) -> DataFrame:
    """``rows`` whose keys no earlier batch fired, with their batch id."""
    before = _read_or_empty(rows.sparkSession, sink_path, schema).where(F.col("batch_id") < batch_id)
    before = before.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(before, same, "left_anti").withColumn("batch_id", F.lit(batch_id).cast("long"))


DEBOUNCE_OUT = "node_id long, run_triggered long, id long, trigger_time timestamp_ntz, message string, batch_id long"


def debounce_stream(assigned_stream: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True):
    """Fire once per (node, run): the earliest trigger (by time, then id) of the
    first batch that holds the key; later batches' triggers of it are dropped.
    Triggers without a run wait for ``assign_triggers`` and are left out."""
    keys = ["node_id", "run_triggered"]

    def sink(batch: DataFrame, batch_id: int):
        first = (batch.where(F.col("run_triggered").isNotNull()).groupBy(*keys)
                 .agg(F.min_by(F.struct("id", "trigger_time", "message"), F.struct("trigger_time", "id")).alias("f"))
                 .select(*keys, "f.*"))
        _write_batch(_not_yet(first, sink_path, DEBOUNCE_OUT, keys, batch_id), sink_path)

    return _start(assigned_stream, sink, checkpoint, available_now)
