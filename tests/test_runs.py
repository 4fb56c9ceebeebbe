"""Runs and triggers on literal scenarios (metric threshold, file counts,
as-of assignment, debounce, barrier, fingerprints)."""

import datetime as dt
import hashlib
import random

import pytest


from runledger.operators import fingerprint as FP
from runledger.operators import runs as R
from runledger.operators.ordered import first_after

T0 = dt.datetime(2024, 1, 1)


def nodes(spark):
    return spark.createDataFrame(
        [(1, "edge_deployment_client", "BaseActionNode", "BaseActionNode"),
         (2, "data_store", "FilesystemStoreNode", "BaseResourceNode"),
         (3, "metadata_store", "SQLiteMetadataStoreNode", "BaseMetadataStoreNode")],
        "id long, node_name string, node_type string, base_type string")


def test_metric_trigger_fires_above_point_four_not_at_it(spark):
    # accuracy 0.0, 0.1 ... 0.9 logged one by one; "max > 0.4" is strict
    vals = [round(0.1 * i, 1) for i in range(10)]
    fired_at = None
    for k in range(1, len(vals) + 1):
        m = spark.createDataFrame([(i, 0, 1, "percent_accuracy", v) for i, v in enumerate(vals[:k])],
                                  "id long, run_id long, node_id long, metric_name string, metric_value double")
        if R.metric_triggers(m, nodes(spark), 0.4, "max", "percent_accuracy").count():
            fired_at = vals[k - 1]
            break
    assert fired_at == 0.5


def test_count_trigger_min_new(spark):
    a = spark.createDataFrame([(i, 2, "new" if i < 3 else "used") for i in range(5)],
                              "id long, node_id long, state string")
    assert R.count_triggers(a, nodes(spark), 2).first()["num_new"] == 3
    assert R.count_triggers(a, nodes(spark), 4).count() == 0


def test_log_triggers_drops_missing_message(spark):
    c = spark.createDataFrame([(1, "a"), (2, None)], "id long, message string")
    assert [r.id for r in R.log_triggers(c).collect()] == [1]


def _brute_first_after(events, marks):
    out = {}
    for eid, t in events:
        later = sorted((mt, mv) for mt, mv in marks if mt > t)
        out[eid] = later[0][1] if later else None
    return out


def test_first_after_matches_brute_force_with_skew(spark):
    rnd = random.Random(7)
    # a third of the events share one instant; runs are sparse
    hot = T0 + dt.timedelta(hours=5)
    events = [(i, hot if i % 3 == 0 else T0 + dt.timedelta(minutes=rnd.randint(0, 3000))) for i in range(300)]
    marks = [(T0 + dt.timedelta(minutes=rnd.randint(0, 3200)), k) for k in range(12)]
    marks.append((hot, 99))            # a run starting exactly at the hot instant: not "after"
    ev = spark.createDataFrame(events, "id long, t timestamp_ntz")
    mk = spark.createDataFrame(marks, "mt timestamp_ntz, run_id long")
    got = {r.id: r.nxt for r in first_after(ev, "t", mk, "mt", "run_id", "nxt", n_buckets=8).collect()}
    assert got == _brute_first_after(events, marks)


def test_assign_triggers_strict_and_keeps_claimed(spark):
    runs = spark.createDataFrame([(0, T0 + dt.timedelta(hours=1)), (1, T0 + dt.timedelta(hours=2))],
                                 "run_id long, start_time timestamp_ntz")
    tr = spark.createDataFrame(
        [(1, None, 2, T0, "a"), (2, None, 2, T0 + dt.timedelta(hours=1), "at start"),
         (3, None, 2, T0 + dt.timedelta(hours=3), "late"), (4, 7, 2, T0, "claimed")],
        "id long, run_triggered long, node_id long, trigger_time timestamp_ntz, message string")
    got = {r.id: r.run_triggered for r in R.assign_triggers(tr, runs, n_buckets=4).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: 7}


def test_first_triggers_debounce(spark):
    a = spark.createDataFrame(
        [(1, 0, 2, T0 + dt.timedelta(minutes=5), "x"), (2, 0, 2, T0 + dt.timedelta(minutes=1), "y"),
         (3, 1, 2, T0 + dt.timedelta(minutes=9), "z")],
        "id long, run_triggered long, node_id long, trigger_time timestamp_ntz, message string")
    got = {(r.run_triggered, r.id, r.num_triggers) for r in R.first_triggers(a).collect()}
    assert got == {(0, 2, 2), (1, 3, 1)}


def test_run_barrier_needs_every_node(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    tr = spark.createDataFrame(
        [(1, 0, h(23)), (2, 0, h(25)), (1, 0, h(26)), (1, 1, h(30)), (9, 1, h(31)), (2, None, h(40)), (1, None, h(60))],
        "node_id long, run_triggered long, trigger_time timestamp_ntz")
    req = spark.createDataFrame([(1,), (2,)], "node_id long")
    rows = {r.run_id: r for r in R.run_barrier(tr, req).collect()}
    assert rows[0].ready and rows[0].run_number == 0 and rows[0].start_time == h(25)      # across midnight
    assert not rows[1].ready and rows[1].n_fired == 1 and rows[1].run_number is None
    assert rows[None].ready and rows[None].run_number == 1 and rows[None].start_time == h(60)


def test_start_run_inserts_a_row_and_claims_what_came_before(spark):
    runs = spark.createDataFrame([(0, T0, T0)], "run_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    tr = spark.createDataFrame([(1, None, T0), (2, 0, T0), (3, None, T0 + dt.timedelta(days=2))],
                               "id long, run_triggered long, trigger_time timestamp_ntz")
    row, claimed = R.start_run(runs, tr, T0 + dt.timedelta(days=1))
    assert row.first().run_id == 1 and row.first().end_time is None
    assert [(r.id, r.run_triggered) for r in claimed.collect()] == [(1, 1)]


def test_current_run(spark):
    r = spark.createDataFrame([(0, T0, T0), (1, T0, None)], "run_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    assert R.current_run(r).first()[0] == 1
    assert R.current_run(r.where("run_id = 0")).first()[0] == 1
    assert R.current_run(r.where("run_id < 0")).first()[0] == 0


def test_release_sends_using_and_produced_to_unused(spark):
    a = spark.createDataFrame([(1, 5, "using"), (2, 5, "produced"), (3, 5, "used"), (4, None, "new"), (5, 6, "using")],
                              "id long, run_id long, state string")
    got = {r.id: (r.state, r.released) for r in R.release_artifacts(a, spark.createDataFrame([(5,)], "run_id long")).collect()}
    assert got == {1: ("unused", True), 2: ("unused", True), 3: ("used", False), 4: ("new", False), 5: ("using", False)}


def _tree_digest(lines):
    leaves = {}
    for x in sorted({f"{x}*{lines.count(x)}" for x in lines}):
        leaves.setdefault(hashlib.sha256(x.rsplit("*", 1)[0].encode()).hexdigest()[:3], []).append(x)
    digests = [hashlib.sha256("\n".join(v).encode()).hexdigest() for _, v in sorted(leaves.items())]
    return hashlib.sha256("".join(digests).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 20, 3000])
def test_fingerprint_is_one_two_level_digest_at_every_size(spark, n):
    hashes = [hashlib.sha256(f"f{i % 1700}".encode()).hexdigest() for i in range(n)]
    rows = [(i, 5, "used", h) for i, h in enumerate(hashes)]
    a1 = spark.createDataFrame(rows, "id long, run_id long, state string, hash string")
    a2 = spark.createDataFrame(list(reversed(rows)), "id long, run_id long, state string, hash string").repartition(3)
    assert FP.artifact_fingerprint(a1).first().artifact_hash == _tree_digest(hashes)
    assert FP.artifact_fingerprint(a2).first().artifact_hash == _tree_digest(hashes)


def test_metadata_hash_empty_parts(spark):
    runs = spark.createDataFrame([(0,)], "run_id long")
    empty_m = spark.createDataFrame([], "id long, run_id long, metric_name string, metric_value double")
    empty_p = spark.createDataFrame([], "id long, run_id long, param_name string, param_value string")
    empty_t = spark.createDataFrame([], "id long, run_id long, tag_name string, tag_value string")
    r = FP.run_metadata_hash(runs, empty_m, empty_p, empty_t).first()
    e = hashlib.sha256(b"").hexdigest()
    assert r.metrics_hash == r.params_hash == r.tags_hash == e
    assert r.metadata_hash == hashlib.sha256((e * 3).encode()).hexdigest()


def test_first_after_fast_path_matches_brute_force(spark):
    rnd = random.Random(11)
    hot = T0 + dt.timedelta(hours=7)
    events = [(i, hot if i % 3 == 0 else T0 + dt.timedelta(minutes=rnd.randint(0, 3000))) for i in range(300)]
    events.append((999, None))
    marks = [(T0 + dt.timedelta(minutes=rnd.randint(0, 3200)), k) for k in range(20)]
    marks += [(hot, 77), (hot, 55)]          # two runs at the hot instant: neither is "after" it
    marks.append((marks[0][0], 5))            # a tie at another instant: lowest value wins
    ev = spark.createDataFrame(events, "id long, t timestamp_ntz")
    mk = spark.createDataFrame(marks, "mt timestamp_ntz, run_id long")
    got = {r.id: r.nxt for r in first_after(ev, "t", mk, "mt", "run_id", "nxt", n_buckets=64).collect()}
    expect = _brute_first_after([e for e in events if e[1] is not None], marks)
    expect[999] = None
    assert got == expect


def test_metric_between_runs_belongs_to_next_run(spark):
    runs = spark.createDataFrame([(0, T0, T0 + dt.timedelta(hours=1)), (1, T0 + dt.timedelta(hours=2),
                                  T0 + dt.timedelta(hours=3)), (2, T0 + dt.timedelta(hours=4), None)],
                                 "run_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    m = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=30)), (2, T0 + dt.timedelta(hours=1)),
                               (3, T0 + dt.timedelta(hours=1, minutes=30)), (4, T0 + dt.timedelta(hours=5))],
                              "id long, logged_at timestamp_ntz")
    got = {r.id: r.assigned_run for r in R.metric_runs(m, runs).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}
