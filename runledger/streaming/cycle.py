"""T-2, T-4, A-6: the run cycle of a node as a fold over its events.

A node is armed at first.  New artifacts are counted; when ``min_new`` of them
wait, the node fires, which starts a run with all that wait.  It stays fired,
whatever arrives, until that run ends; then it is armed again, and fires at
once if enough arrived in the meantime.

Between two run ends only the number of arrivals matters, so events become
stretches first: a running count of a node's run ends numbers them, and their
arrivals are counted.  The fold reads a node's stretches in order, one at a
time, and holds no more than the node's state.  The same fold serves a whole
table and a stream, whose batches pass on one row per node; what fires does not
depend on where the batches are cut, as long as a node's events arrive in order
of time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .discovery import _read_or_empty, _write_batch

STATE_SCHEMA = "node_name string, waiting long, fired boolean, cycle long"
FIRES_SCHEMA = "node_name string, cycle long, num_new long, cause string, batch_id long"
RUN_END = "run_end"


FOLDED_SCHEMA = "node_name string, waiting long, fired boolean, cycle long, num_new long, cause string"


def _stretches(events: DataFrame) -> DataFrame:
    """(node_name, k, n): arrivals after the k-th run end of a node in
    ``events`` (0: before the first).  An arrival at the very time of a run end
    counts after it."""
    over = (F.col("kind") == RUN_END) & F.col("at").isNotNull()
    at = events.where("kind IS NOT NULL").groupBy("node_name", "at").agg(
        F.count_if(over).alias("ends"), F.count_if(F.col("kind") != RUN_END).alias("n"))
    until = Window.partitionBy("node_name").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = at.select("node_name", F.sum("ends").over(until).alias("k"), "ends", "n")
    # run ends at one time have nothing between them
    return placed.groupBy("node_name", "k").agg(F.max("ends").alias("ends"), F.sum("n").alias("n"))


def _fold(min_new: int):
    """States and fires of stretches that stand in order, a node's together."""
    def run(batches):
        node, state, out = None, (0, False, 0), []

        def fire(n, cause, left):
            nonlocal state
            state = (left, True, state[2] + 1)
            out.append((node, None, None, state[2], n, cause))

        def arrive(n):
            nonlocal state
            waiting, fired, cycle = state
            if not fired and waiting + n >= min_new:
                fire(min_new, "arrivals", waiting + n - min_new)
            else:
                state = (waiting + n, fired, cycle)

        def end():
            nonlocal state
            waiting, fired, cycle = state
            if fired and waiting >= min_new:
                fire(waiting, "run_end", 0)
            else:
                state = (waiting, False, cycle)

        def made():
            rows = pd.DataFrame(out, columns=["node_name", "waiting", "fired", "cycle", "num_new", "cause"])
            out.clear()
            return rows.astype({"waiting": "Int64", "fired": "boolean", "cycle": "Int64", "num_new": "Int64"})

        for pdf in batches:
            for name, ends, n, waiting, fired, cycle in zip(*(pdf[c].tolist() for c in ("node_name", "ends", "n", "waiting", "fired", "cycle"))):
                if name != node:
                    if node is not None:
                        out.append((node, *state, None, None))
                    node, state = name, (waiting, fired, cycle)
                    if ends:
                        arrive(0)
                for i in range(ends):
                    if i:
                        if state[1] is False and state[0] < min_new:
                            break                          # run ends of a node that has not fired
                        arrive(0)
                    end()
                arrive(n)
            yield made()
        if node is not None:
            out.append((node, *state, None, None))
            yield made()
    return run


def fold_cycle(events: DataFrame, state: DataFrame, min_new: int = 1) -> DataFrame:
    """Events (node_name, at, kind: ``run_end`` or any arrival) after ``state``
    (node_name, waiting, fired, cycle).  Rows of two kinds: a fire (cycle,
    num_new, cause), and, with a null cause, the new waiting, fired and cycle of
    each node of either.  A run end of a node that has not fired changes
    nothing."""
    j = _stretches(events.where("node_name IS NOT NULL")).join(state, "node_name", "full")
    none = F.lit(0).cast("long")
    steps = j.select("node_name", F.coalesce("k", none).alias("k"), F.coalesce("ends", none).alias("ends"), F.coalesce("n", none).alias("n"),
                     F.coalesce("waiting", none).alias("waiting"), F.coalesce("fired", F.lit(False)).alias("fired"),
                     F.coalesce("cycle", none).alias("cycle"))
    return steps.repartition("node_name").sortWithinPartitions("node_name", "k").mapInPandas(_fold(min_new), FOLDED_SCHEMA)


def fires(folded: DataFrame) -> DataFrame:
    """One row per fire of ``fold_cycle``: node_name, cycle, num_new, cause."""
    return folded.where("cause IS NOT NULL").select("node_name", "cycle", "num_new", "cause")


def run_cycle(events: DataFrame, min_new: int = 1) -> DataFrame:
    """The fires of a whole table of events."""
    return fires(fold_cycle(events, events.sparkSession.createDataFrame([], STATE_SCHEMA), min_new))


def cycle_stream(events_stream: DataFrame, sink_path: str, checkpoint: str, min_new: int = 1, available_now: bool = True):
    """The run cycle as a stream.  A batch reads the states that the batch
    before left (one row per node, two folders in turn) and writes its fires
    and states, so a batch that is run again reads and rewrites the same."""
    def sink(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        before = _read_or_empty(spark, f"{sink_path}/_state/{(batch_id - 1) % 2}", STATE_SCHEMA) if batch_id else \
            spark.createDataFrame([], STATE_SCHEMA)
        folded = fold_cycle(batch, before, min_new).persist()
        _write_batch(fires(folded).withColumn("batch_id", F.lit(batch_id).cast("long")), f"{sink_path}/fires")
        folded.where("cause IS NULL").select("node_name", "waiting", "fired", "cycle").write.mode("overwrite").parquet(f"{sink_path}/_state/{batch_id % 2}")
        folded.unpersist()

    w = events_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_fires(spark, sink_path: str) -> DataFrame:
    return _read_or_empty(spark, f"{sink_path}/fires", FIRES_SCHEMA)
