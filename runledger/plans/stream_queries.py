"""Structured Streaming queries (T-1..T-7).

Each query drops stand-in input files (written once from the driver tables
into the shared checkpoint folder), runs the stream to completion with an
``availableNow`` trigger, and returns the sink table it produced.  The final
sink state must equal the batch twin of the operator, which is what the
oracle checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import epoch_micros
from ..operators import runs as R
from ..operators.ordered import bucket_of, quantile_bounds
from ..session import fresh_scratch, scratch_path
from ..sources import fixtures as X
from ..sources import files as FS
from ..sources import standin as ST
from ..sources.tables import load
from ..streaming import cycle as RC
from ..streaming import discovery as D
from ..streaming import status as SS
from ..streaming import triggers as TR
from .card_queries import W
from .registry import query
from .run_queries import _ASSIGN_SQL

_EXT = "CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.txt' END"
_LOC = f"lang || '/' || CAST(doc_id AS VARCHAR) || {_EXT}"


ROWS_PER_FILE = 1_000_000


def _write_drop(df, path):
    """One drop, in as many files as its rows need."""
    df.repartition(df.count() // ROWS_PER_FILE + 1).write.mode("overwrite").parquet(path)


def _drop(spark, sf, name, df, n_files=1, order_col=None):
    """Write ``df`` as ``n_files`` input drops, oldest data first (one write
    per drop so file times follow event time)."""
    root = scratch_path(spark, "standin", ST._key(sf, name))
    if ST._done(root):
        return root
    if order_col is None or n_files == 1:
        _write_drop(df, f"{root}/part-000")
    else:
        df = df.persist()                         # computed once, split into n_files drops
        x = epoch_micros(order_col).cast("double")
        bounds = quantile_bounds([df.select(x.alias("_x"))], n_files)
        b = df.withColumn("_chunk", bucket_of(x, bounds))
        for i in range(len(bounds) + 1):          # a fixed number of drops
            _write_drop(b.where(F.col("_chunk") == i).drop("_chunk"), f"{root}/part-{i:03d}")
        df.unpersist()
    ST._mark(root, {"drops": n_files})
    return root


def _metric_drop(spark, sf):
    m = X.metrics(spark, sf).select("run_id", "node_id", "metric_name", "metric_value", "logged_at")
    return _drop(spark, sf, "metrics-drop", m, n_files=4, order_col="logged_at")


def _assigned_drop(spark, sf):
    assigned = R.assign_triggers(X.triggers(spark, sf), X.runs(spark, sf))
    return _drop(spark, sf, "assigned-drop", assigned, n_files=4, order_col="trigger_time")


def _status_drops(spark, sf):
    s = X.status_events(spark, sf)
    # two child servers (even and odd node numbers) relay into the parent
    num = F.regexp_extract("node_name", r"(\d+)$", 1).cast("int")
    a = _drop(spark, sf, "status-even", s.where(num % 2 == 0), n_files=3, order_col="ts")
    b = _drop(spark, sf, "status-odd", s.where(num % 2 == 1), n_files=3, order_col="ts")
    return a, b


def _snapshot_drop(spark, sf):
    root = scratch_path(spark, "standin", ST._key(sf, "snapshots"))
    if not ST._done(root):
        # one file per snapshot version, written oldest first
        X.snap_old(spark, sf).withColumn("version", F.lit(0).cast("long")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{root}/v0")
        X.snap_new(spark, sf).withColumn("version", F.lit(1).cast("long")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{root}/v1")
        ST._mark(root, {"versions": 2})
    return root


def prepare_inputs(spark, sf):
    """Write every stream's stand-in input drop (idempotent)."""
    ST.document_tree(spark, sf)
    ST.odd_tree(spark, sf)
    _metric_drop(spark, sf)
    _assigned_drop(spark, sf)
    _status_drops(spark, sf)
    _snapshot_drop(spark, sf)
    _drop(spark, sf, "cycle-drop", _cycle_events(spark, sf), n_files=4, order_col="at")


def _stream(spark, path, max_files=1):
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(path))


_SCAN_SQL = f"""SELECT source AS node_name, {_LOC} AS location, CAST(strlen(text) AS BIGINT) AS size,
                   sha256(text) AS hash FROM documents"""


@query("stream_artifacts", _SCAN_SQL)
def q_stream_artifacts(spark, sf):
    root = ST.document_tree(spark, sf)
    out = fresh_scratch(spark, "stream-artifacts")
    q = D.discover(spark, root, f"{out}/catalog", f"{out}/_checkpoint")
    q.awaitTermination()
    return D.read_catalog(spark, f"{out}/catalog").select("node_name", "location", "size", "hash")


@query("stream_odd_artifacts", f"""
    SELECT node_name, location, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM ({ST.ODD_SQL})""")
def q_stream_odd_artifacts(spark, sf):
    # hidden, empty and oddly named files, of which a bulk scan has catalogued some before
    root = ST.odd_tree(spark, sf)
    out = fresh_scratch(spark, "stream-odd")
    known = FS.list_files(spark, root).where("size = 0 AND location LIKE '%/.%'")
    D.discover(spark, root, f"{out}/catalog", f"{out}/_checkpoint", base_catalog=known).awaitTermination()
    cols = ["node_name", "location", "size", "hash"]
    return D.read_catalog(spark, f"{out}/catalog").select(cols).unionByName(FS.hash_listed(known).select(cols))


@query("stream_count_trigger", """
    SELECT source AS node_name, 1::BIGINT AS n_fires, count(*) AS num_files, true AS said, true AS enough
    FROM documents GROUP BY source HAVING count(*) >= 3""")
def q_stream_count_trigger(spark, sf):
    root = ST.document_tree(spark, sf)
    out = fresh_scratch(spark, "stream-count")
    q = D.discover(spark, root, f"{out}/catalog", f"{out}/_checkpoint",
                   trigger_path=f"{out}/triggers", min_new=3)
    q.awaitTermination()
    # no run ends: a node fires once, and what comes later waits
    says = F.col("message") == F.concat(F.lit("Detected "), F.col("num_new").cast("string"), F.lit(" new artifacts"))
    fired = D.read_fired(spark, f"{out}/triggers").groupBy("node_name").agg(
        F.count(F.lit(1)).alias("n_fires"), F.sum("num_new").alias("taken"), F.bool_and(says).alias("said"),
        F.bool_and(F.col("num_new") >= 3).alias("enough"))
    waiting = D.read_counts(spark, f"{out}/triggers").select("node_name", "num_new")
    return fired.join(waiting, "node_name").select("node_name", "n_fires", (F.col("taken") + F.col("num_new")).alias("num_files"), "said", "enough")


_CYCLE_SQL = """
    WITH RECURSIVE e AS (
      SELECT 'src' || user_id % 20 AS node_name, event_type = 'purchase' AS is_end,
             row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_type = 'purchase' DESC, event_id) AS k
      FROM events WHERE event_type IN ('view', 'click', 'purchase')),
    s AS (
      SELECT DISTINCT node_name, 0::BIGINT AS k, 0::BIGINT AS waiting, false AS fired, 0::BIGINT AS cycle, NULL::BIGINT AS num_new, NULL::VARCHAR AS cause FROM e
      UNION ALL
      SELECT node_name, k, CASE WHEN fires THEN CASE WHEN is_end THEN 0 ELSE waiting - 2 END WHEN is_end THEN waiting ELSE waiting + 1 END,
             CASE WHEN is_end THEN fires ELSE fired OR fires END, cycle + CASE WHEN fires THEN 1 ELSE 0 END,
             CASE WHEN fires THEN CASE WHEN is_end THEN waiting ELSE 3 END END, CASE WHEN fires THEN CASE WHEN is_end THEN 'run_end' ELSE 'arrivals' END END
      FROM (SELECT s.node_name, e.k, s.waiting, s.fired, s.cycle, e.is_end,
                   CASE WHEN e.is_end THEN s.fired AND s.waiting >= 3 ELSE NOT s.fired AND s.waiting + 1 >= 3 END AS fires
            FROM s JOIN e ON e.node_name = s.node_name AND e.k = s.k + 1))
    SELECT node_name, cycle, num_new, cause FROM s WHERE cause IS NOT NULL"""


def _cycle_events(spark, sf):
    """Views and clicks as arrivals, purchases as run ends."""
    ev = load(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return ev.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("node_name"), F.col("ts").alias("at"),
                     F.when(F.col("event_type") == "purchase", RC.RUN_END).otherwise("file").alias("kind"))


@query("run_cycle", _CYCLE_SQL)
def q_run_cycle(spark, sf):
    return RC.run_cycle(_cycle_events(spark, sf), min_new=3)


@query("stream_run_cycle", _CYCLE_SQL)
def q_stream_run_cycle(spark, sf):
    src = _drop(spark, sf, "cycle-drop", _cycle_events(spark, sf), n_files=4, order_col="at")
    out = fresh_scratch(spark, "stream-cycle")
    RC.cycle_stream(_stream(spark, src), out, f"{out}/_checkpoint", min_new=3).awaitTermination()
    return RC.read_fires(spark, out).drop("batch_id")


@query("stream_metric_trigger", W("""
    SELECT m.run_id, n.node_name, m.metric_name, max(m.metric_value) AS agg_value
    FROM metrics m JOIN nodes n ON m.node_id = n.id
    GROUP BY ALL HAVING max(m.metric_value) > 300.0""", "metrics"))
def q_stream_metric_trigger(spark, sf):
    src = _metric_drop(spark, sf)
    out = fresh_scratch(spark, "stream-metric")
    q = TR.metric_max_stream(_stream(spark, src), f"{out}/updates", f"{out}/_checkpoint")
    q.awaitTermination()
    upd = spark.read.schema(TR.METRIC_SINK_SCHEMA).parquet(f"{out}/updates")
    final = TR.latest_values(upd, ["run_id", "node_id", "metric_name"])
    n = X.nodes(spark, sf).select(F.col("id").alias("node_id"), "node_name")
    return (final.where(F.col("agg_value") > 300.0).join(n, "node_id")
            .select("run_id", "node_name", "metric_name", "agg_value"))


@query("stream_metric_fired", W("""
    SELECT m.run_id, n.node_name, m.metric_name, 'max(' || m.metric_name || ') > 300.0' AS message, true AS above
    FROM metrics m JOIN nodes n ON m.node_id = n.id WHERE m.metric_value > 300.0 GROUP BY ALL""", "metrics"))
def q_stream_metric_fired(spark, sf):
    src = _metric_drop(spark, sf)
    out = fresh_scratch(spark, "stream-metric-fired")
    TR.metric_trigger_stream(_stream(spark, src), f"{out}/fired", f"{out}/_checkpoint", 300.0).awaitTermination()
    n = X.nodes(spark, sf).select(F.col("id").alias("node_id"), "node_name")
    return (spark.read.schema(TR.FIRED_SCHEMA).parquet(f"{out}/fired").join(n, "node_id")
            .select("run_id", "node_name", "metric_name", "message", (F.col("metric_value") > 300).alias("above")))


@query("stream_debounce", W(f"""WITH {_ASSIGN_SQL}
    SELECT node_id, run_triggered, id, trigger_time, message FROM (
      SELECT *, row_number() OVER (PARTITION BY node_id, run_triggered ORDER BY trigger_time, id) AS rn
      FROM assigned WHERE run_triggered IS NOT NULL) WHERE rn = 1""", "triggers", "runs"))
def q_stream_debounce(spark, sf):
    src = _assigned_drop(spark, sf)
    out = fresh_scratch(spark, "stream-debounce")
    q = TR.debounce_stream(_stream(spark, src), f"{out}/fired", f"{out}/_checkpoint")
    q.awaitTermination()
    return spark.read.schema(TR.DEBOUNCE_OUT).parquet(f"{out}/fired").drop("batch_id")


@query("stream_latest_status", W("""
    SELECT node_name, status, ts, id FROM (
      SELECT *, row_number() OVER (PARTITION BY node_name ORDER BY ts DESC, id DESC) AS rn FROM status_events)
    WHERE rn = 1""", "status_events"))
def q_stream_latest_status(spark, sf):
    a, b = _status_drops(spark, sf)
    out = fresh_scratch(spark, "stream-status")
    q = SS.latest_status_stream(SS.relay([_stream(spark, a), _stream(spark, b)]), f"{out}/latest",
                                f"{out}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/latest")


@query("stream_changefeed", W("""
    SELECT id, 'added' AS change, CAST(NULL AS VARCHAR) AS old_state, state AS new_state, CAST(0 AS BIGINT) AS version
    FROM snap_old
    UNION ALL
    SELECT n.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END, o.state, n.state, CAST(1 AS BIGINT)
    FROM snap_new n LEFT JOIN snap_old o ON o.id = n.id
    WHERE o.id IS NULL OR o.state IS DISTINCT FROM n.state""", "snap_old", "snap_new"))
def q_stream_changefeed(spark, sf):
    root = _snapshot_drop(spark, sf)
    out = fresh_scratch(spark, "stream-feed")
    q = SS.change_feed(_stream(spark, root), f"{out}/state", f"{out}/feed", f"{out}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/feed").select("id", "change", "old_state", "new_state",
                                                    F.col("version").cast("long").alias("version"))
