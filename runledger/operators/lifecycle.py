"""Artifact lifecycle, node status history, snapshots and run-to-run change.

The reference keeps this state in mutable rows and thread variables; here it
is folded from append-only event tables.  Folds are aggregations
(``max_by``/``min_by``), which Spark pre-reduces map-side, so a hot artifact
or node never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import micros_between
from .ordered import next_in_group


# W-1 -----------------------------------------------------------------------
def latest_status(status_events: DataFrame) -> DataFrame:
    """Latest status per node; ties on ``ts`` go to the higher id."""
    return (status_events.groupBy("node_name")
            .agg(F.max_by(F.struct("status", "ts", "id"), F.struct("ts", "id")).alias("s"))
            .select("node_name", F.col("s.status").alias("status"), F.col("s.ts").alias("ts"),
                    F.col("s.id").alias("id")))


# W-2 -----------------------------------------------------------------------
def artifact_state(marks: DataFrame) -> DataFrame:
    """Fold ordered marks into the current state per artifact.

    ``state`` is the last mark's state; ``run_id`` is the run of the last mark
    that carried one (``mark_using`` writes the run, ``mark_used`` does not)."""
    return marks.groupBy("artifact_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.max_by("run_id", F.when(F.col("run_id").isNotNull(), F.col("seq"))).alias("run_id"),
        F.count(F.lit(1)).alias("num_marks"),
        F.max("seq").alias("last_seq"))


# K-15 ----------------------------------------------------------------------
def apply_marks(artifacts: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply folded marks to the catalog.  Returns (updated artifacts,
    unmatched marks).  Unmatched marks are the reference's "no artifact
    found" errors, returned as rows instead of raised."""
    fold = artifact_state(marks)
    ids = artifacts.select(F.col("id").alias("artifact_id"))
    unmatched = fold.join(ids, "artifact_id", "left_anti")
    f = fold.select(F.col("artifact_id").alias("id"), F.col("state").alias("_state"),
                    F.col("run_id").alias("_run"))
    updated = (artifacts.join(f, "id", "left")
               .withColumn("state", F.coalesce("_state", "state"))
               .withColumn("run_id", F.coalesce("_run", "run_id"))
               .drop("_state", "_run"))
    return updated, unmatched


# W-6 -----------------------------------------------------------------------
def metric_delta(metrics: DataFrame, agg: str = "max") -> DataFrame:
    """Per metric and run: the run's value and the change against run - 1.

    Values are first reduced per (metric, run), then joined to the previous
    run by key (``run_id = prev + 1``), so nothing is windowed per metric."""
    fn = {"max": F.max, "min": F.min}[agg]
    per = metrics.groupBy("metric_name", "run_id").agg(fn("metric_value").alias("value"))
    prev = per.select("metric_name", (F.col("run_id") + 1).alias("run_id"), F.col("value").alias("prev_value"))
    return (per.join(prev, ["metric_name", "run_id"], "left")
            .withColumn("delta", F.col("value") - F.col("prev_value")))


# J-6 -----------------------------------------------------------------------
def compare_prev_run(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (node, run): artifact count and bytes next to the previous run's."""
    per = (artifacts.where(F.col("run_id").isNotNull())
           .groupBy("node_id", "run_id")
           .agg(F.count(F.lit(1)).alias("n_artifacts"), F.sum("size").alias("total_size")))
    prev = per.select("node_id", (F.col("run_id") + 1).alias("run_id"),
                      F.col("n_artifacts").alias("prev_n_artifacts"), F.col("total_size").alias("prev_total_size"))
    return (per.join(prev, ["node_id", "run_id"], "left")
            .join(nodes.select(F.col("id").alias("node_id"), "node_name"), "node_id")
            .select("node_name", "run_id", "n_artifacts", "total_size", "prev_n_artifacts", "prev_total_size"))


# W-7 -----------------------------------------------------------------------
def status_durations(status_events: DataFrame, n_buckets: int = 64) -> DataFrame:
    """Per node: time spent in each status before the next one, and counts
    of every (status -> next status) transition."""
    nxt = next_in_group(status_events.select("node_name", "status", "ts", "id"), ["node_name"], "ts", "id",
                        ["status", "ts"], n_buckets=n_buckets)
    dur = micros_between("ts", "next_ts")
    return (nxt.groupBy("node_name", "status", F.col("next_status"))
            .agg(F.count(F.lit(1)).alias("n_transitions"), F.sum(dur).alias("total_duration_us")))


# J-7 / T-6 / C-9 ---------------------------------------------------------------
def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", value: str = "state") -> DataFrame:
    """Rows added since ``old`` and rows whose ``value`` changed."""
    o = old.select(F.col(key), F.col(value).alias("old_" + value), F.lit(True).alias("_known"))
    j = new.select(F.col(key), F.col(value).alias("new_" + value)).join(o, key, "left")
    change = (F.when(F.col("_known").isNull(), F.lit("added"))
              .when(~F.col("old_" + value).eqNullSafe(F.col("new_" + value)), F.lit("changed")))
    return (j.withColumn("change", change).where(F.col("change").isNotNull())
            .select(key, "change", "old_" + value, "new_" + value))


# N-16 ----------------------------------------------------------------------
def validate_values(df: DataFrame, col: str, domain: list[str], domain_name: str) -> DataFrame:
    """Count each distinct value of ``col`` and flag whether it is allowed."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(domain_name).alias("domain"), "value", "n",
                    F.coalesce(F.col("value").isin(domain), F.lit(False)).alias("valid")))


# X-2 -----------------------------------------------------------------------
def action_outcomes(runs: DataFrame) -> DataFrame:
    """Classify job outcomes: raised -> ERROR, truthy -> COMPLETE, else FAILURE;
    the successor signal is SUCCESS only for a truthy return.

    Input columns: ``run_id, node_name, returned`` (nullable boolean) and
    ``raised`` (boolean)."""
    status = (F.when(F.col("raised"), F.lit("ERROR"))
              .when(F.coalesce(F.col("returned"), F.lit(False)), F.lit("COMPLETE"))
              .otherwise(F.lit("FAILURE")))
    signal = F.when(~F.col("raised") & F.coalesce(F.col("returned"), F.lit(False)), F.lit("SUCCESS")) \
        .otherwise(F.lit("FAILURE"))
    return runs.select("run_id", "node_name", status.alias("status"), signal.alias("signal"),
                       F.lit("CLEANUP").alias("final_status"))
