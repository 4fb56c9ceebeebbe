"""Run driver and extension hooks (X-1 .. X-6).

A user job is a Python callable ``execute(spark, run_id, inputs) -> bool``
that itself runs Spark jobs; the driver calls it once per run, around the
reference's hooks, and records the outcome as rows:

* ``execute`` returns truthy -> COMPLETE (signal SUCCESS), falsy -> FAILURE,
  raises -> ERROR (signal FAILURE); CLEANUP always follows;
* ``before_execution``, ``after_execution``, ``on_success``, ``on_failure``
  and ``on_error(exc)`` are optional;
* trigger predicates are DataFrame -> DataFrame functions (X-4, X-5).

The per-run loop is on the driver because runs are sequential by nature
(a run starts after the previous one closes); every step inside a run is a
distributed DataFrame job.
"""

from __future__ import annotations

import datetime as dt
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import runs as R

OUTCOME_SCHEMA = ("run_id long, node_name string, status string, signal string, error string, "
                  "started_at timestamp_ntz, ended_at timestamp_ntz")


@dataclass
class Action:
    """One action node: a job body plus optional hooks."""
    name: str
    execute: Callable[[SparkSession, int, DataFrame | None], bool]
    before_execution: Callable[[], None] | None = None
    after_execution: Callable[[], None] | None = None
    on_success: Callable[[], None] | None = None
    on_failure: Callable[[], None] | None = None
    on_error: Callable[[BaseException], None] | None = None


@dataclass
class RunHooks:
    """X-6: called at run start and run end."""
    before_run_starts: Callable[[int], None] | None = None
    before_run_ends: Callable[[int], None] | None = None


def _call(hook, *args):
    if hook is not None:
        hook(*args)


def run_action(spark: SparkSession, action: Action, run_id: int, inputs: DataFrame | None = None) -> dict:
    """X-1 / X-2 / X-3: run one action for one run; returns its outcome row."""
    started = dt.datetime.now()
    error = None
    ret = None
    _call(action.before_execution)
    try:
        ret = action.execute(spark, run_id, inputs)
        if ret:
            status = "COMPLETE"
            _call(action.on_success)
        else:
            status = "FAILURE"
            _call(action.on_failure)
    except Exception as exc:  # noqa: BLE001 - the outcome is recorded, not raised
        status = "ERROR"
        error = "".join(traceback.format_exception_only(type(exc), exc)).strip()
        _call(action.on_error, exc)
    finally:
        _call(action.after_execution)
    return {"run_id": run_id, "node_name": action.name, "status": status,
            "signal": "SUCCESS" if (status == "COMPLETE") else "FAILURE",
            "error": error, "started_at": started, "ended_at": dt.datetime.now()}


def run_actions(spark: SparkSession, actions: list[Action], run_id: int,
                inputs: DataFrame | None = None, hooks: RunHooks | None = None) -> DataFrame:
    """Run every action of one run in order; outcome rows as a DataFrame
    (one row per action - append it to the status table)."""
    hooks = hooks or RunHooks()
    _call(hooks.before_run_starts, run_id)
    rows = [run_action(spark, a, run_id, inputs) for a in actions]
    _call(hooks.before_run_ends, run_id)
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


# X-4 / X-5: trigger predicates ------------------------------------------------

def default_resource_trigger(min_new: int = 1) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The stock resource trigger (>= ``min_new`` new artifacts), as a
    replaceable predicate ``fn(artifacts, nodes) -> DataFrame[node_name, message]``."""
    def fn(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
        return R.count_triggers(artifacts, nodes, min_new).select("node_name", "message")
    return fn


def default_metric_trigger(threshold: float, metric_name: str | None = None, agg: str = "max"):
    """The example metric trigger: ``agg(metric) > threshold`` per (run, node)."""
    def fn(metrics: DataFrame, nodes: DataFrame) -> DataFrame:
        return R.metric_triggers(metrics, nodes, threshold, agg, metric_name).select(
            "run_id", "node_name", "message")
    return fn


@dataclass
class RunCycle:
    """One store-driven run: evaluate triggers, start when every required
    input fired, run the actions, close.  Everything it reads and returns is
    a DataFrame; only the yes/no decision comes to the driver."""
    required_nodes: list[str]
    resource_trigger: Callable[[DataFrame, DataFrame], DataFrame] = field(
        default_factory=default_resource_trigger)
    metric_trigger: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def fired(self, artifacts: DataFrame, nodes: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
        f = self.resource_trigger(artifacts, nodes).select("node_name", "message")
        if self.metric_trigger is not None and metrics is not None:
            f = f.unionByName(self.metric_trigger(metrics, nodes).select("node_name", "message"))
        return R.log_triggers(f)

    def ready(self, fired: DataFrame) -> bool:
        need = set(self.required_nodes)
        got = fired.where(F.col("node_name").isin(list(need))).select("node_name").distinct().count()
        return got == len(need)
