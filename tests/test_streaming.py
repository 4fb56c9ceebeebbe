"""Streaming operators equal their batch twins; replays are harmless."""

import datetime as dt
import hashlib
import os
import random
import time

import pytest

from runledger.operators import lifecycle as L
from runledger.streaming import cycle as CY
from runledger.streaming import discovery as D
from runledger.streaming import status as SS
from runledger.streaming import triggers as TR

T0 = dt.datetime(2024, 1, 1)


def _files(root, lo, hi, node="data_store"):
    os.makedirs(os.path.join(root, node), exist_ok=True)
    for i in range(lo, hi):
        with open(os.path.join(root, node, f"test_leaf_file{i}.txt"), "w") as f:
            f.write(f"test file {i}")


def test_discovery_two_drops_each_file_once(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    _files(root, 0, 10)
    base = spark.createDataFrame([("data_store", "test_leaf_file0.txt")], "node_name string, location string")
    D.discover(spark, root, f"{out}/cat", f"{out}/ck", max_files_per_trigger=4, base_catalog=base).awaitTermination()
    _files(root, 10, 20)
    D.discover(spark, root, f"{out}/cat", f"{out}/ck", max_files_per_trigger=4, base_catalog=base).awaitTermination()
    cat = D.read_catalog(spark, f"{out}/cat").collect()
    locs = sorted(r.location for r in cat)
    assert locs == sorted(f"test_leaf_file{i}.txt" for i in range(1, 20))
    h = {r.location: r.hash for r in cat}
    assert h["test_leaf_file7.txt"] == hashlib.sha256(b"test file 7").hexdigest()


def test_discovery_takes_every_file(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    names = ["n/.hidden", "n/_x", "n/a b %20.txt", "n/empty", "n/_deep/.er/é+", "at root"]
    for k, n in enumerate(names):
        os.makedirs(os.path.dirname(os.path.join(root, n)), exist_ok=True)
        with open(os.path.join(root, n), "wb") as f:
            f.write(b"" if n.endswith("empty") else b"x" * (3_000_000 + k))         # several read chunks
    D.discover(spark, root, f"{out}/cat", f"{out}/ck").awaitTermination()
    got = {(f"{r.node_name}/" if r.node_name else "") + r.location: (r.size, r.hash) for r in D.read_catalog(spark, f"{out}/cat").collect()}
    assert got == {n: (os.path.getsize(os.path.join(root, n)), hashlib.sha256(open(os.path.join(root, n), "rb").read()).hexdigest()) for n in names}


def test_a_replayed_batch_takes_the_same_files(spark, tmp):
    import shutil
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    _files(root, 0, 5)
    D.discover(spark, root, f"{out}/cat", f"{out}/ck").awaitTermination()
    _files(root, 5, 8)
    D.discover(spark, root, f"{out}/cat", f"{out}/ck").awaitTermination()
    shutil.copytree(f"{out}/ck", f"{out}/crashed", ignore=lambda d, names: [n for n in names if d.endswith("commits") and n in ("1", ".1.crc")])
    _files(root, 8, 9)
    for _ in range(2):                                     # batch 1 was planned and not committed: it runs again
        D.discover(spark, root, f"{out}/cat", f"{out}/crashed").awaitTermination()
    got = [(r.batch_id, r.location) for r in D.read_catalog(spark, f"{out}/cat").collect()]
    assert sorted(got) == [(0 if i < 5 else 1 if i < 8 else 2, f"test_leaf_file{i}.txt") for i in range(9)]


def test_batch_write_is_idempotent(spark, tmp):
    df = spark.createDataFrame([("n", "a", 1, "h", 0)], "node_name string, location string, size long, hash string, batch_id long")
    D._write_batch(df, tmp + "/cat")
    D._write_batch(df, tmp + "/cat")            # a replay of batch 0
    assert D.read_catalog(spark, tmp + "/cat").count() == 1


def test_count_trigger_fires_once_at_threshold(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    _files(root, 0, 9, "a")
    _files(root, 0, 2, "b")
    D.discover(spark, root, f"{out}/cat", f"{out}/ck", max_files_per_trigger=3,
               trigger_path=f"{out}/trg", min_new=4).awaitTermination()
    fired = D.read_fired(spark, f"{out}/trg").collect()
    assert [r.node_name for r in fired] == ["a"] and fired[0].num_new >= 4


def test_count_trigger_is_armed_again_when_its_run_ends(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")

    def go():
        D.discover(spark, root, f"{out}/cat", f"{out}/ck", max_files_per_trigger=50, trigger_path=f"{out}/trg", min_new=3).awaitTermination()
        return sorted((r.node_name, r.cycle, r.num_new) for r in D.read_fired(spark, f"{out}/trg").collect())

    _files(root, 0, 4, "a")
    _files(root, 0, 2, "b")
    assert go() == [("a", 1, 4)]
    _files(root, 4, 9, "a")
    assert go() == [("a", 1, 4)]                          # its run goes on
    D.end_runs(D.read_fired(spark, f"{out}/trg"), f"{out}/trg")
    D.end_runs(D.read_fired(spark, f"{out}/trg"), f"{out}/trg")          # told twice
    _files(root, 2, 4, "b")
    assert go() == [("a", 1, 4), ("a", 2, 5), ("b", 1, 4)]
    _files(root, 9, 20, "a")
    assert go()[:2] == [("a", 1, 4), ("a", 2, 5)]         # the first run's end does not end the second
    waiting = {r.node_name: (r.num_new, r.fired, r.cycle) for r in D.read_counts(spark, f"{out}/trg").collect()}
    assert waiting == {"a": (11, True, 2), "b": (0, True, 1)}


def _cycle_by_hand(events, min_new):
    out, state = [], {}
    for node, _, kind in sorted(events, key=lambda e: (e[1], e[2] != "run_end")):
        waiting, fired, cycle = state.get(node, (0, False, 0))
        waiting += kind != "run_end"
        if kind == "run_end" and not fired:
            pass
        elif (kind == "run_end" or not fired) and waiting >= min_new:
            cycle, fired = cycle + 1, True
            out.append((node, cycle, waiting, "run_end" if kind == "run_end" else "arrivals"))
            waiting = 0
        elif kind == "run_end":
            fired = False
        state[node] = (waiting, fired, cycle)
    return sorted(out), state


@pytest.mark.parametrize("min_new", [1, 2, 5])
def test_run_cycle_against_single_events(spark, tmp, min_new):
    rng = random.Random(min_new)
    events = [(rng.choice("aaab"), t, "run_end" if rng.random() < 0.2 else "file") for t in range(400)]
    events += [("c", 3, "file"), ("c", 3, "file"), ("c", 3, "run_end"), ("only ends", 5, "run_end")]
    fires, state = _cycle_by_hand(events, min_new)
    schema = "node_name string, at long, kind string"
    got = CY.run_cycle(spark.createDataFrame(events + [(None, 1, "file")], schema), min_new).collect()
    assert sorted(tuple(r) for r in got) == fires
    for k, (lo, hi) in enumerate([(0, 90), (90, 91), (91, 300), (300, 400)]):      # cuts of any size
        _drop(spark, spark.createDataFrame([e for e in events if lo <= e[1] < hi], schema), f"{tmp}/in/p{k}")
        time.sleep(0.05)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    CY.cycle_stream(s, f"{tmp}/out", f"{tmp}/ck", min_new).awaitTermination()
    assert sorted(tuple(r)[:4] for r in CY.read_fires(spark, f"{tmp}/out").collect()) == fires
    last = spark.read.schema(CY.STATE_SCHEMA).parquet(f"{tmp}/out/_state/1")
    assert {r.node_name: (r.waiting, r.fired, r.cycle) for r in last.collect()} == state


def _drop(spark, df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)


def test_metric_stream_equals_batch(spark, tmp):
    rows = [(i, 0, 1, "percent_accuracy", round(0.1 * i, 1)) for i in range(10)]
    m = spark.createDataFrame(rows, "id long, run_id long, node_id long, metric_name string, metric_value double")
    _drop(spark, m.where("id < 5"), f"{tmp}/in/p0")
    _drop(spark, m.where("id >= 5"), f"{tmp}/in/p1")
    s = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    TR.metric_max_stream(s, f"{tmp}/upd", f"{tmp}/ck").awaitTermination()
    final = TR.latest_values(spark.read.parquet(f"{tmp}/upd"), ["run_id", "node_id", "metric_name"]).first()
    assert final.agg_value == 0.9


def test_debounce_first_arrival_wins_across_batches(spark, tmp):
    schema = "node_id long, run_triggered long, id long, trigger_time timestamp_ntz, message string"
    d1 = spark.createDataFrame([(1, 0, 10, T0 + dt.timedelta(minutes=5), "first"),
                                (1, 0, 11, T0 + dt.timedelta(minutes=6), "second")], schema)
    d2 = spark.createDataFrame([(1, 0, 12, T0 + dt.timedelta(minutes=7), "third"),
                                (2, 0, 13, T0 + dt.timedelta(minutes=8), "other")], schema)
    _drop(spark, d1, f"{tmp}/in/p0")
    _drop(spark, d2, f"{tmp}/in/p1")
    s = spark.readStream.schema(d1.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    TR.debounce_stream(s, f"{tmp}/out", f"{tmp}/ck").awaitTermination()
    got = {(r.node_id, r.id) for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got == {(1, 10), (2, 13)}


def test_relayed_latest_status_equals_batch(spark, tmp):
    ev = spark.createDataFrame([(i, f"n{i % 3}", ["QUEUED", "EXECUTING", "COMPLETE"][i % 3], T0 + dt.timedelta(seconds=i))
                                for i in range(30)], "id long, node_name string, status string, ts timestamp_ntz")
    _drop(spark, ev.where("id % 2 = 0"), f"{tmp}/a/p0")
    _drop(spark, ev.where("id % 2 = 1"), f"{tmp}/b/p0")
    sa = spark.readStream.schema(ev.schema).parquet(f"{tmp}/a/*")
    sb = spark.readStream.schema(ev.schema).parquet(f"{tmp}/b/*")
    SS.latest_status_stream(SS.relay([sa, sb]), f"{tmp}/out", f"{tmp}/ck").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got == {tuple(r) for r in L.latest_status(ev).collect()}


def test_change_feed_versions_and_replay(spark, tmp):
    from runledger.streaming.status import change_feed
    schema = "version long, id long, state string"
    v0 = spark.createDataFrame([(0, 1, "new"), (0, 2, "used")], schema)
    v1 = spark.createDataFrame([(1, 1, "used"), (1, 2, "used"), (1, 3, "new")], schema)
    _drop(spark, v0, f"{tmp}/in/v0")
    _drop(spark, v1, f"{tmp}/in/v1")
    s = spark.readStream.schema(v0.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    change_feed(s, f"{tmp}/state", f"{tmp}/feed", f"{tmp}/ck").awaitTermination()
    got = {(r.version, r.id, r.change) for r in spark.read.parquet(f"{tmp}/feed").collect()}
    assert got == {(0, 1, "added"), (0, 2, "added"), (1, 1, "changed"), (1, 3, "added")}


def test_debounce_keeps_on_time_keys_of_late_files_and_replays(spark, tmp):
    schema = "node_id long, run_triggered long, id long, trigger_time timestamp_ntz, message string"
    d1 = spark.createDataFrame([(1, 0, 1, T0 + dt.timedelta(days=9), "x")], schema)
    d2 = spark.createDataFrame([(2, 0, 2, T0, "late"), (2, 0, 3, T0 + dt.timedelta(days=9), "on time"), (3, None, 4, T0, "no run")], schema)
    _drop(spark, d1, f"{tmp}/in/p0")
    _drop(spark, d2, f"{tmp}/in/p1")
    for k in ("ck", "ck-again"):             # a lost checkpoint replays all batches into the same sink
        s = spark.readStream.schema(d1.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
        TR.debounce_stream(s, f"{tmp}/out", f"{tmp}/{k}").awaitTermination()
        assert sorted((r.node_id, r.id) for r in spark.read.parquet(f"{tmp}/out").collect()) == [(1, 1), (2, 2)]


def test_metric_trigger_fires_once_above_the_threshold(spark, tmp):
    schema = "run_id long, node_id long, metric_name string, metric_value double"
    for k, v in enumerate([0.4, 0.9, 0.95]):
        _drop(spark, spark.createDataFrame([(0, 1, "acc", v), (0, 1, "loss", 0.8)], schema), f"{tmp}/in/p{k}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    TR.metric_trigger_stream(s, f"{tmp}/out", f"{tmp}/ck", 0.8).awaitTermination()
    assert [(r.metric_name, r.metric_value, r.message) for r in spark.read.parquet(f"{tmp}/out").collect()] == \
        [("acc", 0.9, "max(acc) > 0.8")]



def test_bounded_batches_take_everything_in_the_end(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    _files(root, 0, 7)
    q = D.discover(spark, root, f"{out}/cat", f"{out}/ck", max_files_per_trigger=3, processing_time="100 milliseconds")
    try:
        q.processAllAvailable()
        sizes = sorted(r["count"] for r in D.read_catalog(spark, f"{out}/cat").groupBy("batch_id").count().collect())
        assert sizes == [1, 3, 3]
    finally:
        q.stop()


def test_continuous_discovery_with_processing_time_trigger(spark, tmp):
    root, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    _files(root, 0, 5)
    q = D.discover(spark, root, f"{out}/cat", f"{out}/ck", processing_time="200 milliseconds")
    try:
        q.processAllAvailable()
        assert D.read_catalog(spark, f"{out}/cat").count() == 5
        _files(root, 5, 8)                      # files keep arriving while the stream runs
        q.processAllAvailable()
        locs = sorted(r.location for r in D.read_catalog(spark, f"{out}/cat").collect())
        assert locs == sorted(f"test_leaf_file{i}.txt" for i in range(8))
    finally:
        q.stop()
