"""Lifecycle folds, status history, snapshots; the keyed ordered scan is
checked against a brute-force scan with a hot key."""

import datetime as dt
import random

from runledger.operators import lifecycle as L
from runledger.operators.ordered import next_in_group

T0 = dt.datetime(2024, 1, 1)


def test_fold_last_mark_wins_and_only_using_sets_run(spark):
    marks = spark.createDataFrame([(1, 0, "new", None), (1, 1, "using", 4), (1, 2, "used", None),
                                   (2, 0, "using", 3), (2, 1, "using", 5)],
                                  "artifact_id long, seq long, state string, run_id long")
    got = {r.artifact_id: (r.state, r.run_id) for r in L.artifact_state(marks).collect()}
    assert got == {1: ("used", 4), 2: ("using", 5)}


def test_fold_is_idempotent(spark):
    marks = spark.createDataFrame([(1, 0, "using", 2), (1, 1, "used", None)],
                                  "artifact_id long, seq long, state string, run_id long")
    once = L.artifact_state(marks)
    twice = L.artifact_state(once.selectExpr("artifact_id", "last_seq AS seq", "state", "run_id"))
    assert {tuple(r)[:3] for r in once.collect()} == {tuple(r)[:3] for r in twice.collect()}


def test_apply_marks_reports_unmatched(spark):
    arts = spark.createDataFrame([(1, "new", None)], "id long, state string, run_id long")
    marks = spark.createDataFrame([(1, 0, "using", 9), (8, 0, "used", None)],
                                  "artifact_id long, seq long, state string, run_id long")
    upd, bad = L.apply_marks(arts, marks)
    assert [tuple(r) for r in upd.collect()] == [(1, "using", 9)]
    assert [r.artifact_id for r in bad.collect()] == [8]


def test_latest_status_tie_breaks_on_id(spark):
    ev = spark.createDataFrame([(1, "a", "QUEUED", T0), (2, "a", "EXECUTING", T0), (3, "b", "ERROR", T0)],
                               "id long, node_name string, status string, ts timestamp_ntz")
    got = {r.node_name: r.status for r in L.latest_status(ev).collect()}
    assert got == {"a": "EXECUTING", "b": "ERROR"}


def test_next_in_group_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        node = "hot" if i % 3 == 0 else f"n{rnd.randint(0, 9)}"
        rows.append((i, node, rnd.choice(["QUEUED", "EXECUTING", "COMPLETE"]),
                     T0 + dt.timedelta(seconds=rnd.randint(0, 500))))
    df = spark.createDataFrame(rows, "id long, node_name string, status string, ts timestamp_ntz")
    got = {r.id: (r.next_status, r.next_ts) for r in
           next_in_group(df, ["node_name"], "ts", "id", ["status", "ts"], n_buckets=6).collect()}
    expect = {}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for node, rs in by.items():
        rs.sort(key=lambda r: (r[3], r[0]))
        for a, b in zip(rs, rs[1:] + [None]):
            expect[a[0]] = (b[2], b[3]) if b else (None, None)
    assert got == expect


def test_status_durations(spark):
    ev = spark.createDataFrame([(1, "a", "QUEUED", T0), (2, "a", "EXECUTING", T0 + dt.timedelta(seconds=2)),
                                (3, "a", "COMPLETE", T0 + dt.timedelta(seconds=5))],
                               "id long, node_name string, status string, ts timestamp_ntz")
    got = {(r.status, r.next_status): r.total_duration_us for r in L.status_durations(ev, n_buckets=2).collect()}
    assert got == {("QUEUED", "EXECUTING"): 2_000_000, ("EXECUTING", "COMPLETE"): 3_000_000, ("COMPLETE", None): None}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "new"), (2, "used")], "id long, state string")
    new = spark.createDataFrame([(1, "used"), (2, "used"), (3, "new")], "id long, state string")
    got = {(r.id, r.change) for r in L.snapshot_diff(old, new).collect()}
    assert got == {(1, "changed"), (3, "added")}


def test_metric_delta_previous_run(spark):
    m = spark.createDataFrame([(0, "loss", 2.0), (1, "loss", 1.5), (3, "loss", 1.0)],
                              "run_id long, metric_name string, metric_value double")
    got = {r.run_id: (r.prev_value, r.delta) for r in L.metric_delta(m).collect()}
    assert got == {0: (None, None), 1: (2.0, -0.5), 3: (None, None)}


def test_action_outcomes(spark):
    df = spark.createDataFrame([(0, "a", True, False), (0, "b", None, False), (0, "c", True, True)],
                               "run_id long, node_name string, returned boolean, raised boolean")
    got = {r.node_name: (r.status, r.signal) for r in L.action_outcomes(df).collect()}
    assert got == {"a": ("COMPLETE", "SUCCESS"), "b": ("FAILURE", "FAILURE"), "c": ("ERROR", "FAILURE")}


def test_validate_values(spark):
    df = spark.createDataFrame([("new",), ("bogus",), (None,)], "state string")
    got = {r.value: r.valid for r in L.validate_values(df, "state", ["new"], "d").collect()}
    assert got == {"new": True, "bogus": False, None: False}


def test_top_k_per_group_matches_brute_force_with_hot_group(spark):
    from pyspark.sql import functions as F
    from runledger.operators.ordered import top_k_per_group
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 101) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {(r.g, r.rank, r.id) for r in top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5,
                                                          salts=8, salt_col="id").collect()}
    expect = set()
    for g in {r[1] for r in rows}:
        rs = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:5]
        expect |= {(g, i + 1, r[0]) for i, r in enumerate(rs)}
    assert got == expect


def test_durations_ignore_session_time_zone(spark):
    # 01:30 -> 03:30 local on a spring-forward day is two hours of NTZ time
    ev = spark.createDataFrame([(1, "a", "QUEUED", dt.datetime(2024, 3, 10, 1, 30)),
                                (2, "a", "EXECUTING", dt.datetime(2024, 3, 10, 3, 30))],
                               "id long, node_name string, status string, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = {r.status: r.total_duration_us for r in L.status_durations(ev, n_buckets=2).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got["QUEUED"] == 2 * 3600 * 1_000_000


def test_next_in_group_hot_key_at_one_instant(spark):
    rnd = random.Random(5)
    rows = []
    hot_t = T0 + dt.timedelta(seconds=100)
    for i in range(900):
        if i % 3 == 0:
            rows.append((i, "hot", "QUEUED", hot_t))            # a third: one key, one instant
        else:
            rows.append((i, rnd.choice(["hot", "a", "b"]), "EXECUTING", T0 + dt.timedelta(seconds=rnd.randint(0, 300))))
    df = spark.createDataFrame(rows, "id long, node_name string, status string, ts timestamp_ntz")
    out = next_in_group(df, ["node_name"], "ts", "id", ["status", "ts", "id"], n_buckets=8)
    got = {r.id: r.next_id for r in out.collect()}
    expect = {}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (r[3], r[0]))
        for a, b2 in zip(rs, rs[1:] + [None]):
            expect[a[0]] = b2[0] if b2 else None
    assert got == expect
