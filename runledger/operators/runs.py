"""Runs and triggers: trigger predicates, trigger -> run assignment, run
barrier and numbering, run close, current run.

Every per-group step is an aggregation (partial aggregation map-side, so a
hot node or run is pre-reduced before the shuffle) or uses the bucketed
ordered helpers in ``ordered.py``; no step puts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprint import run_hash
from .ids import assign_ids
from .ordered import first_after, top_k_per_group


# A-5 + P-12 ----------------------------------------------------------------
def metric_triggers(metrics: DataFrame, nodes: DataFrame, threshold: float,
                    agg: str = "max", metric_name: str | None = None) -> DataFrame:
    """Per (run, node, metric): aggregate the values; fire when strictly above
    ``threshold``.  Returns only firing groups, with a trigger message."""
    fn = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}[agg]
    m = metrics if metric_name is None else metrics.where(F.col("metric_name") == F.lit(metric_name))
    g = m.groupBy("run_id", "node_id", "metric_name").agg(fn("metric_value").alias("agg_value"))
    fired = g.where(F.col("agg_value") > F.lit(threshold))
    return (fired.join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
            .select("run_id", "node_name", "metric_name", "agg_value",
                    F.concat(F.lit(f"{agg}("), "metric_name", F.lit(f") > {threshold}")).alias("message")))


# A-7 -----------------------------------------------------------------------
def count_triggers(artifacts: DataFrame, nodes: DataFrame, min_new: int = 1) -> DataFrame:
    """Resource trigger: a node fires when it holds at least ``min_new`` new artifacts."""
    g = artifacts.where(F.col("state") == "new").groupBy("node_id").agg(F.count(F.lit(1)).alias("num_new"))
    return (g.where(F.col("num_new") >= min_new)
            .join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
            .select("node_name", "num_new",
                    F.concat(F.lit("Detected "), F.col("num_new").cast("string"),
                             F.lit(" new artifacts")).alias("message")))


# K-12 ----------------------------------------------------------------------
def log_triggers(candidates: DataFrame) -> DataFrame:
    """Only triggers that carry a message are logged."""
    return candidates.where(F.col("message").isNotNull())


# J-4 / K-13 ------------------------------------------------------------------
def assign_triggers(triggers: DataFrame, runs: DataFrame, n_buckets: int = 64) -> DataFrame:
    """Pending triggers (``run_triggered`` NULL) take the id of the first run
    that starts strictly after them; triggers already claimed keep theirs."""
    pending = triggers.where(F.col("run_triggered").isNull())
    claimed = triggers.where(F.col("run_triggered").isNotNull())
    solved = first_after(pending.drop("run_triggered"), "trigger_time", runs, "start_time", "run_id",
                         "run_triggered", n_buckets=n_buckets)
    return solved.select(*triggers.columns).unionByName(claimed)


# C10 -----------------------------------------------------------------------
def metric_runs(metrics: DataFrame, runs: DataFrame, time_col: str = "logged_at",
                n_buckets: int = 64) -> DataFrame:
    """Run of each metric by time: run k takes what was logged after run
    k-1 ended and no later than run k's end; what comes after the last
    closed run belongs to the current run (the open one, else max + 1).

    ``t <= end`` is the strict as-of on ``t - 1 microsecond`` (timestamps
    are whole microseconds)."""
    closed = runs.where(F.col("end_time").isNotNull())
    shifted = metrics.withColumn("_t", F.col(time_col) - F.expr("INTERVAL 1 MICROSECOND"))
    assigned = first_after(shifted, "_t", closed, "end_time", "run_id", "_run", n_buckets=n_buckets)
    cur = current_run(runs).first()["run_id"]          # one scalar
    return (assigned.withColumn("assigned_run", F.coalesce("_run", F.lit(cur).cast("long")))
            .drop("_t", "_run"))


# W-3 -----------------------------------------------------------------------
def first_triggers(assigned: DataFrame) -> DataFrame:
    """Debounce: the first trigger of every (node, run); ties by id."""
    return (assigned.where(F.col("run_triggered").isNotNull())
            .groupBy("node_id", "run_triggered")
            .agg(F.min_by(F.struct("id", "trigger_time", "message"), F.struct("trigger_time", "id")).alias("f"),
                 F.count(F.lit(1)).alias("num_triggers"))
            .select("node_id", "run_triggered", F.col("f.id").alias("id"),
                    F.col("f.trigger_time").alias("trigger_time"), F.col("f.message").alias("message"),
                    "num_triggers"))


# A-6 + W-5 -------------------------------------------------------------------
def run_barrier(assigned: DataFrame, required: DataFrame) -> DataFrame:
    """A run can start once every required node has fired since the last one.

    ``assigned`` are triggers with the run that claimed them (null: the cycle
    that is still waiting).  A node that fired stays fired until the run of
    its cycle ends, so the cycle, not the calendar, groups the triggers.  Per
    cycle: the required nodes that fired, whether all did, and if so the
    latest of their first fires (the barrier time) and the run's place (0, 1,
    ...) in barrier order."""
    req = required.select("node_id").distinct()
    n_required = req.count()        # one scalar: the size of the pipeline's input set
    first = (assigned.join(req, "node_id", "left_semi").groupBy("run_triggered", "node_id")
             .agg(F.min("trigger_time").alias("first_fire")))
    per = first.groupBy("run_triggered").agg(F.count(F.lit(1)).alias("n_fired"), F.max("first_fire").alias("barrier_time"))
    per = per.withColumn("n_required", F.lit(n_required).cast("long")).withColumn(
        "ready", F.col("n_fired") == F.col("n_required"))
    ready = assign_ids(per.where("ready"), ["barrier_time", "run_triggered"], -1, "run_number")
    cols = [F.col("run_triggered").alias("run_id"), "n_fired", "n_required", "ready"]
    return ready.select(*cols, F.col("barrier_time").alias("start_time"), "run_number").unionByName(
        per.where("NOT ready").select(*cols, F.lit(None).cast("timestamp_ntz").alias("start_time"),
                                      F.lit(None).cast("long").alias("run_number")))


# P-13 ----------------------------------------------------------------------
def current_run(runs: DataFrame) -> DataFrame:
    """The open run's id, else the next id (max + 1; 0 for an empty catalog)."""
    return runs.agg(
        F.coalesce(F.max(F.when(F.col("end_time").isNull(), F.col("run_id"))),
                   F.max("run_id") + 1, F.lit(0).cast("long")).alias("run_id"))


# K-14 ----------------------------------------------------------------------
def close_runs(runs: DataFrame, artifacts: DataFrame, metrics: DataFrame, params: DataFrame,
               tags: DataFrame, end_time) -> DataFrame:
    """Close every open run: set ``end_time`` and the run hash.  Only the open
    runs' records are read on: history is not digested again."""
    open_runs = runs.where(F.col("end_time").isNull())
    ids = open_runs.select("run_id")
    artifacts, metrics, params, tags = (df.join(ids, "run_id", "left_semi") for df in (artifacts, metrics, params, tags))
    h = run_hash(open_runs, artifacts, metrics, params, tags).select("run_id", F.col("run_hash").alias("_h"))
    return (runs.join(h, "run_id", "left")
            .select("run_id", "start_time",
                    F.coalesce("end_time", F.lit(end_time).cast("timestamp_ntz")).alias("end_time"),
                    F.when(F.col("end_time").isNull(), F.col("_h")).otherwise(F.col("hash")).alias("hash")))


def release_artifacts(artifacts: DataFrame, ending: DataFrame) -> DataFrame:
    """Run end: artifacts that a run of ``ending`` (run_id) leaves ``using`` or
    ``produced`` become ``unused``; those of other runs keep their state.
    Returns all artifacts with ``released``."""
    ends = ending.select("run_id").distinct().withColumn("_ends", F.lit(True))
    out = artifacts.join(ends, "run_id", "left").withColumn(
        "released", F.coalesce(F.col("_ends") & F.col("state").isin("using", "produced"), F.lit(False)))
    return out.withColumn("state", F.when(F.col("released"), F.lit("unused")).otherwise(F.col("state"))).select(
        *artifacts.columns, "released")


# K-13 ----------------------------------------------------------------------
def start_run(runs: DataFrame, triggers: DataFrame, start_time) -> tuple[DataFrame, DataFrame]:
    """Start of a run: the run row to insert (the id after the last, open) and
    the pending triggers it claims, those logged before its start."""
    at = F.lit(start_time).cast("timestamp_ntz")
    row = runs.agg(F.coalesce(F.max("run_id") + 1, F.lit(0).cast("long")).alias("run_id")).select(
        "run_id", at.alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(None).cast("string").alias("hash"))
    run_id = row.first()["run_id"]                     # one scalar
    pending = triggers.where(F.col("run_triggered").isNull() & (F.col("trigger_time") < at))
    return row, pending.withColumn("run_triggered", F.lit(run_id).cast("long"))


# O-5 -----------------------------------------------------------------------
def top_metric_runs(metrics: DataFrame, k: int, agg: str = "max") -> DataFrame:
    """Best ``k`` runs per metric by the run's aggregated value (top-k report).

    Values are reduced per (metric, run) first; the ranking is the salted
    two-phase top-k, so one metric with most of the runs is not one task."""
    fn = {"max": F.max, "min": F.min}[agg]
    per_run = metrics.groupBy("metric_name", "run_id").agg(fn("metric_value").alias("best_value"))
    return top_k_per_group(per_run, ["metric_name"], [F.col("best_value").desc(), F.col("run_id")], k,
                           salt_col="run_id")
