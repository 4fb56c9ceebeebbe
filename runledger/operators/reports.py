"""Report views (P-11): the column subsets the store's web pages show, with
timestamps in display format.  HTML is not built; these are the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_time


def report_runs(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", display_time("start_time").alias("start_time"),
                       display_time("end_time").alias("end_time"), F.col("hash").alias("run_hash"))


def report_samples(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id").alias("sample_id"), "run_id", "node_name",
                          display_time("created_at").alias("created_at"), "location", "state", "hash",
                          "hash_algorithm")


def report_metrics(metrics_view: DataFrame) -> DataFrame:
    return metrics_view.select(F.col("id").alias("entry_id"), "run_id", "node_name",
                               F.col("metric_name").alias("metric"), F.col("metric_value").alias("value"))


def report_params(params_view: DataFrame) -> DataFrame:
    return params_view.select(F.col("id").alias("entry_id"), "run_id", "node_name", "param_name",
                              F.col("param_value").alias("value"))


def report_tags(tags_view: DataFrame) -> DataFrame:
    return tags_view.select(F.col("id").alias("entry_id"), "run_id", "node_name", "tag_name",
                            F.col("tag_value").alias("value"))


def report_triggers(triggers_view: DataFrame) -> DataFrame:
    return triggers_view.select(F.col("id").alias("trigger_id"), "run_triggered",
                                F.col("node_name").alias("triggered_by"),
                                display_time("trigger_time").alias("trigger_time"), "message")
