"""Run, trigger and fingerprint queries (A-2..A-7, A-11, J-4, K-12..K-14,
P-13, W-3, W-5, O-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import micros_between
from ..operators import fingerprint as FP
from ..operators import runs as R
from ..sources import fixtures as X
from ..sources.tables import load
from .registry import query

W = X.with_fixtures

CLOSE_AT = "2024-02-01 00:00:00"

# DuckDB pieces shared by the fingerprint oracles -----------------------------
_ART_CAT = f"""al AS (SELECT run_id, hash AS line FROM artifacts WHERE run_id IS NOT NULL AND state <> 'new'),
 art AS {FP.tree_digest_sql("al", "run_id")}"""
_META = f"""ml AS (SELECT run_id, CAST(id AS VARCHAR) || '|' || coalesce(metric_name, '') || '|' ||
                    coalesce(CAST(CAST(metric_value AS DECIMAL(18,6)) AS VARCHAR), '') AS line FROM metrics
        WHERE run_id IS NOT NULL),
 pl AS (SELECT run_id, CAST(id AS VARCHAR) || '|' || coalesce(param_name, '') || '|' ||
                    coalesce(param_value, '') AS line FROM params WHERE run_id IS NOT NULL),
 tl AS (SELECT run_id, CAST(id AS VARCHAR) || '|' || coalesce(tag_name, '') || '|' ||
                    coalesce(tag_value, '') AS line FROM tags WHERE run_id IS NOT NULL),
 mh AS {FP.tree_digest_sql("ml", "run_id")},
 ph AS {FP.tree_digest_sql("pl", "run_id")},
 th AS {FP.tree_digest_sql("tl", "run_id")},
 meta AS (SELECT r.run_id, coalesce(mh.digest, sha256('')) AS metrics_hash,
                 coalesce(ph.digest, sha256('')) AS params_hash, coalesce(th.digest, sha256('')) AS tags_hash,
                 sha256(coalesce(mh.digest, sha256('')) || coalesce(ph.digest, sha256('')) || coalesce(th.digest, sha256('')))
                   AS metadata_hash
          FROM {{runs}} r LEFT JOIN mh USING (run_id) LEFT JOIN ph USING (run_id) LEFT JOIN th USING (run_id))"""
_FIX = ("runs", "artifacts", "metrics", "params", "tags")


def _cat(spark, sf):
    return {k: getattr(X, k)(spark, sf) for k in _FIX}


@query("metric_triggers", W("""
    SELECT m.run_id, n.node_name, m.metric_name, max(m.metric_value) AS agg_value,
           'max(' || m.metric_name || ') > 300.0' AS message
    FROM metrics m JOIN nodes n ON m.node_id = n.id
    GROUP BY ALL HAVING max(m.metric_value) > 300.0""", "metrics"))
def q_metric_triggers(spark, sf):
    return R.metric_triggers(X.metrics(spark, sf), X.nodes(spark, sf), threshold=300.0, agg="max")


@query("count_triggers", W("""
    SELECT n.node_name, count(*) AS num_new, 'Detected ' || CAST(count(*) AS VARCHAR) || ' new artifacts' AS message
    FROM artifacts a JOIN nodes n ON a.node_id = n.id WHERE a.state = 'new'
    GROUP BY n.node_name HAVING count(*) >= 2""", "artifacts"))
def q_count_triggers(spark, sf):
    return R.count_triggers(X.artifacts(spark, sf), X.nodes(spark, sf), min_new=2)


@query("log_triggers", """
    SELECT event_id AS id, 'src' || CAST(user_id % 20 AS VARCHAR) AS node_name, ts AS trigger_time,
           'value = ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS message
    FROM events WHERE event_type = 'error' AND value > 40""")
def q_log_triggers(spark, sf):
    # every error event is a candidate; only those with a message are logged
    ev = load(spark, sf, "events").where(F.col("event_type") == "error")
    cand = ev.select(F.col("event_id").alias("id"),
                     F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("node_name"),
                     F.col("ts").alias("trigger_time"),
                     F.when(F.col("value") > 40, F.concat(F.lit("value = "),
                            F.col("value").cast("decimal(18,2)").cast("string"))).alias("message"))
    return R.log_triggers(cand)


_ASSIGN_SQL = """assigned AS (
    SELECT t.id, (SELECT r.run_id FROM runs r WHERE r.start_time > t.trigger_time
                  ORDER BY r.start_time, r.run_id LIMIT 1) AS run_triggered,
           t.node_id, t.trigger_time, t.message
    FROM triggers t)"""


@query("assign_triggers", W(f"WITH {_ASSIGN_SQL} SELECT * FROM assigned", "triggers", "runs"))
def q_assign_triggers(spark, sf):
    return R.assign_triggers(X.triggers(spark, sf), X.runs(spark, sf))


@query("first_triggers", W(f"""WITH {_ASSIGN_SQL}
    SELECT node_id, run_triggered, id, trigger_time, message, num_triggers FROM (
      SELECT *, row_number() OVER (PARTITION BY node_id, run_triggered ORDER BY trigger_time, id) AS rn,
             count(*) OVER (PARTITION BY node_id, run_triggered) AS num_triggers
      FROM assigned WHERE run_triggered IS NOT NULL) WHERE rn = 1""", "triggers", "runs"))
def q_first_triggers(spark, sf):
    return R.first_triggers(R.assign_triggers(X.triggers(spark, sf), X.runs(spark, sf)))


@query("run_barrier", W(f"""WITH {_ASSIGN_SQL},
    req AS (SELECT id AS node_id FROM nodes WHERE node_name IN ('src0', 'src1')),
    f AS (SELECT run_triggered, node_id, min(trigger_time) AS first_fire
          FROM assigned WHERE node_id IN (SELECT node_id FROM req) GROUP BY ALL),
    per AS (SELECT run_triggered AS run_id, count(*) AS n_fired, max(first_fire) AS barrier_time FROM f GROUP BY ALL),
    nr AS (SELECT count(*) AS n_required FROM req)
    SELECT run_id, n_fired, n_required, n_fired = n_required AS ready,
           CASE WHEN n_fired = n_required THEN barrier_time END AS start_time,
           CASE WHEN n_fired = n_required THEN CAST(row_number() OVER (PARTITION BY n_fired = n_required
                ORDER BY barrier_time, run_id NULLS FIRST) - 1 AS BIGINT) END AS run_number
    FROM per, nr""", "triggers", "nodes", "runs"))
def q_run_barrier(spark, sf):
    # a pipeline whose runs need two of the resource nodes
    req = X.nodes(spark, sf).where(F.col("node_name").isin("src0", "src1")).select(F.col("id").alias("node_id"))
    return R.run_barrier(R.assign_triggers(X.triggers(spark, sf), X.runs(spark, sf)), req)


@query("start_run", W(f"""
    SELECT (SELECT coalesce(max(run_id) + 1, 0) FROM runs) AS run_triggered, id, node_id, trigger_time, message,
           TIMESTAMP '{CLOSE_AT}' AS start_time
    FROM triggers WHERE run_triggered IS NULL AND trigger_time < TIMESTAMP '{CLOSE_AT}'""", "triggers", "runs"))
def q_start_run(spark, sf):
    row, claimed = R.start_run(X.runs(spark, sf), X.triggers(spark, sf), CLOSE_AT)
    return claimed.join(F.broadcast(row.select(F.col("run_id").alias("run_triggered"), "start_time")), "run_triggered")


@query("release_artifacts", W("""
    WITH e AS (SELECT run_id FROM runs WHERE end_time IS NULL OR run_id % 2 = 0)
    SELECT id, a.run_id, coalesce(a.run_id IN (SELECT run_id FROM e) AND state IN ('using', 'produced'), false) AS released,
           CASE WHEN a.run_id IN (SELECT run_id FROM e) AND state IN ('using', 'produced') THEN 'unused' ELSE state END AS state
    FROM artifacts a""", "artifacts", "runs"))
def q_release_artifacts(spark, sf):
    ending = X.runs(spark, sf).where(F.col("end_time").isNull() | (F.col("run_id") % 2 == 0))
    return R.release_artifacts(X.artifacts(spark, sf), ending).select("id", "run_id", "released", "state")


@query("metric_runs", W("""
    WITH cur AS (SELECT coalesce(max(CASE WHEN end_time IS NULL THEN run_id END), max(run_id) + 1, 0) AS c
                 FROM runs)
    SELECT m.id, m.run_id AS logged_run, m.logged_at,
           coalesce((SELECT r.run_id FROM runs r WHERE r.end_time IS NOT NULL AND r.end_time >= m.logged_at
                     ORDER BY r.end_time, r.run_id LIMIT 1), (SELECT c FROM cur)) AS assigned_run
    FROM metrics m""", "metrics", "runs"))
def q_metric_runs(spark, sf):
    m = X.metrics(spark, sf).select("id", F.col("run_id").alias("logged_run"), "logged_at")
    return R.metric_runs(m, X.runs(spark, sf)).select("id", "logged_run", "logged_at", "assigned_run")


@query("current_run", W("""SELECT coalesce(max(CASE WHEN end_time IS NULL THEN run_id END), max(run_id) + 1, 0)
                         AS run_id FROM runs""", "runs"))
def q_current_run(spark, sf):
    return R.current_run(X.runs(spark, sf))


@query("artifact_fingerprint", W("WITH " + _ART_CAT + " SELECT run_id, digest AS artifact_hash FROM art", "artifacts"))
def q_artifact_fingerprint(spark, sf):
    return FP.artifact_fingerprint(X.artifacts(spark, sf))


@query("run_metadata_hash", W("WITH " + _META.format(runs="runs") +
                              " SELECT run_id, metrics_hash, params_hash, tags_hash, metadata_hash FROM meta",
                              *_FIX))
def q_run_metadata_hash(spark, sf):
    c = _cat(spark, sf)
    return FP.run_metadata_hash(c["runs"], c["metrics"], c["params"], c["tags"])


_RUN_HASH_SQL = ("WITH " + _ART_CAT + ",\n " + _META.format(runs="{runs}") + """,
 rh AS (SELECT meta.run_id, meta.metadata_hash, sha256(coalesce(art.digest, sha256('')) || meta.metadata_hash) AS run_hash
        FROM meta LEFT JOIN art USING (run_id))""")


@query("run_hash", W(_RUN_HASH_SQL.format(runs="runs") + " SELECT run_id, metadata_hash, run_hash FROM rh", *_FIX))
def q_run_hash(spark, sf):
    c = _cat(spark, sf)
    return FP.run_hash(c["runs"], c["artifacts"], c["metrics"], c["params"], c["tags"])


@query("close_runs", W(_RUN_HASH_SQL.format(runs="(SELECT * FROM runs WHERE end_time IS NULL)") + f"""
    SELECT r.run_id, r.start_time, coalesce(r.end_time, TIMESTAMP '{CLOSE_AT}') AS end_time,
           CASE WHEN r.end_time IS NULL THEN rh.run_hash ELSE r.hash END AS hash
    FROM runs r LEFT JOIN rh USING (run_id)""", *_FIX))
def q_close_runs(spark, sf):
    c = _cat(spark, sf)
    return R.close_runs(c["runs"], c["artifacts"], c["metrics"], c["params"], c["tags"], CLOSE_AT)


@query("top_metric_runs", W("""
    SELECT metric_name, run_id, best_value, rank FROM (
      SELECT metric_name, run_id, max(metric_value) AS best_value,
             CAST(row_number() OVER (PARTITION BY metric_name ORDER BY max(metric_value) DESC, run_id) AS BIGINT)
               AS rank
      FROM metrics GROUP BY metric_name, run_id) WHERE rank <= 3""", "metrics"))
def q_top_metric_runs(spark, sf):
    return R.top_metric_runs(X.metrics(spark, sf), k=3)


# A-11 flagship ----------------------------------------------------------------
def run_report(spark, sf):
    c = _cat(spark, sf)
    a = c["artifacts"].where(F.col("run_id").isNotNull())
    by_state = a.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_artifacts"),
        *[F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("using", "used", "produced", "unused")])
    met = c["metrics"].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_metrics"),
                                            F.max("metric_value").alias("max_metric"))
    par = c["params"].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_params"))
    trg = (R.assign_triggers(X.triggers(spark, sf), c["runs"])
           .groupBy(F.col("run_triggered").alias("run_id")).agg(F.count(F.lit(1)).alias("n_triggers")))
    h = FP.run_hash(c["runs"], c["artifacts"], c["metrics"], c["params"], c["tags"]).select("run_id", "run_hash")
    r = c["runs"]
    dur = micros_between("start_time", "end_time")
    out = (r.join(by_state, "run_id", "left").join(met, "run_id", "left").join(par, "run_id", "left")
           .join(trg, "run_id", "left").join(h, "run_id", "left"))
    cnt = ["n_artifacts", "n_using", "n_used", "n_produced", "n_unused", "n_metrics", "n_params", "n_triggers"]
    return out.select("run_id", "start_time", "end_time", dur.alias("duration_us"),
                      *[F.coalesce(F.col(x), F.lit(0).cast("long")).alias(x) for x in cnt],
                      "max_metric", "run_hash")


query("run_report", W(_RUN_HASH_SQL.format(runs="runs") + f""",
 {_ASSIGN_SQL},
 bs AS (SELECT run_id, count(*) AS n_artifacts, count(*) FILTER (WHERE state = 'using') AS n_using,
               count(*) FILTER (WHERE state = 'used') AS n_used,
               count(*) FILTER (WHERE state = 'produced') AS n_produced,
               count(*) FILTER (WHERE state = 'unused') AS n_unused
        FROM artifacts WHERE run_id IS NOT NULL GROUP BY run_id),
 mt AS (SELECT run_id, count(*) AS n_metrics, max(metric_value) AS max_metric FROM metrics GROUP BY run_id),
 pr AS (SELECT run_id, count(*) AS n_params FROM params GROUP BY run_id),
 tg AS (SELECT run_triggered AS run_id, count(*) AS n_triggers FROM assigned GROUP BY 1)
 SELECT r.run_id, r.start_time, r.end_time, epoch_us(r.end_time) - epoch_us(r.start_time) AS duration_us,
        coalesce(bs.n_artifacts, 0) AS n_artifacts, coalesce(bs.n_using, 0) AS n_using,
        coalesce(bs.n_used, 0) AS n_used, coalesce(bs.n_produced, 0) AS n_produced,
        coalesce(bs.n_unused, 0) AS n_unused, coalesce(mt.n_metrics, 0) AS n_metrics,
        coalesce(pr.n_params, 0) AS n_params, coalesce(tg.n_triggers, 0) AS n_triggers,
        mt.max_metric, rh.run_hash
 FROM runs r LEFT JOIN bs USING (run_id) LEFT JOIN mt USING (run_id) LEFT JOIN pr USING (run_id)
      LEFT JOIN tg USING (run_id) LEFT JOIN rh USING (run_id)""", *_FIX, "triggers"))(run_report)
