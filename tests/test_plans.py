"""Plan-shape checks: the scale properties the operators rely on."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as E
from runledger.operators import lifecycle as L
from runledger.operators.ordered import first_after

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
T0 = dt.datetime(2024, 1, 1)


def _plan(df):
    df.write.format("noop").mode("overwrite").save()        # final (adaptive) plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_parquet_scan(spark):
    p = _plan(E.queries()["triggers"](spark, SF))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", p)
    assert any("EqualTo(event_type,error)" in x and "GreaterThan(value,40.0)" in x for x in pushed)


def test_scans_read_only_needed_columns(spark):
    p = _plan(E.queries()["metrics"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)


def test_latest_status_is_an_aggregation_not_a_window(spark):
    ev = spark.createDataFrame([(1, "a", "QUEUED", T0)], "id long, node_name string, status string, ts timestamp_ntz")
    p = _plan(L.latest_status(ev))
    assert "Window" not in p and "max_by" in p


def test_metric_trigger_aggregates_before_the_shuffle(spark):
    p = _plan(E.queries()["metric_triggers"](spark, SF))
    assert "partial_max" in p


def test_asof_fast_path_is_a_broadcast_lookup(spark):
    ev = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i)) for i in range(50)], "id long, t timestamp_ntz")
    mk = spark.createDataFrame([(T0 + dt.timedelta(minutes=10 * k), k) for k in range(5)],
                               "mt timestamp_ntz, run_id long")
    p = _plan(first_after(ev, "t", mk, "mt", "run_id", "nxt", n_buckets=16))
    assert "Window" not in p and "BroadcastHashJoin" in p


def test_asof_general_path_has_no_unpartitioned_window_over_events(spark):
    ev = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i)) for i in range(50)], "id long, t timestamp_ntz")
    mk = spark.createDataFrame([(T0 + dt.timedelta(minutes=3 * k), k) for k in range(20)],
                               "mt timestamp_ntz, run_id long")
    p = _plan(first_after(ev, "t", mk, "mt", "run_id", "nxt", n_buckets=4))
    # every window over events is partitioned by the bucket; the only
    # unpartitioned one runs over the bucket grid (n_buckets rows)
    windows = [l for l in p.split("\n") if "Window [" in l]
    assert any("[_b" in l for l in windows)


def test_top_k_is_two_phase(spark):
    p = _plan(E.queries()["recent_artifacts"](spark, SF))
    assert p.count("row_number()") >= 2 and "_salt" in p
