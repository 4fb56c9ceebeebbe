"""Lifecycle, status, snapshot and catalog-write queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import docstore as DS
from ..operators import lifecycle as L
from ..operators import writes as K
from ..sources import fixtures as X
from ..sources.tables import load
from .registry import query

W = X.with_fixtures


def _sql_list(vals):
    return ", ".join(f"'{v}'" for v in vals)


@query("latest_status", W("""
    SELECT node_name, status, ts, id FROM (
      SELECT *, row_number() OVER (PARTITION BY node_name ORDER BY ts DESC, id DESC) AS rn FROM status_events)
    WHERE rn = 1""", "status_events"))
def q_latest_status(spark, sf):
    return L.latest_status(X.status_events(spark, sf))


@query("artifact_state", W("""
    SELECT artifact_id, arg_max(state, seq) AS state,
           arg_max(run_id, seq) FILTER (WHERE run_id IS NOT NULL) AS run_id,
           count(*) AS num_marks, max(seq) AS last_seq
    FROM marks GROUP BY artifact_id""", "marks"))
def q_artifact_state(spark, sf):
    return L.artifact_state(X.marks(spark, sf))


@query("apply_marks", W("""
    WITH f AS (SELECT artifact_id AS id, arg_max(state, seq) AS st,
                      arg_max(run_id, seq) FILTER (WHERE run_id IS NOT NULL) AS rn
               FROM marks GROUP BY 1)
    SELECT a.id, coalesce(f.st, a.state) AS state, coalesce(f.rn, a.run_id) AS run_id, true AS matched
    FROM artifacts a LEFT JOIN f USING (id)
    UNION ALL SELECT id, st, rn, false FROM f WHERE id NOT IN (SELECT id FROM artifacts)""", "artifacts", "marks"))
def q_apply_marks(spark, sf):
    updated, unmatched = L.apply_marks(X.artifacts(spark, sf), X.marks(spark, sf))
    return updated.select("id", "state", "run_id", F.lit(True).alias("matched")).unionByName(
        unmatched.select(F.col("artifact_id").alias("id"), "state", "run_id", F.lit(False).alias("matched")))


@query("metric_delta", W("""
    WITH per AS (SELECT metric_name, run_id, max(metric_value) AS value FROM metrics GROUP BY ALL)
    SELECT p.metric_name, p.run_id, p.value, q.value AS prev_value, p.value - q.value AS delta
    FROM per p LEFT JOIN per q ON q.metric_name = p.metric_name AND q.run_id + 1 = p.run_id""", "metrics"))
def q_metric_delta(spark, sf):
    return L.metric_delta(X.metrics(spark, sf))


@query("compare_prev_run", W("""
    WITH per AS (SELECT node_id, run_id, count(*) AS n_artifacts, CAST(sum(size) AS BIGINT) AS total_size
                 FROM artifacts WHERE run_id IS NOT NULL GROUP BY ALL)
    SELECT n.node_name, p.run_id, p.n_artifacts, p.total_size,
           q.n_artifacts AS prev_n_artifacts, q.total_size AS prev_total_size
    FROM per p LEFT JOIN per q ON q.node_id = p.node_id AND q.run_id + 1 = p.run_id
    JOIN nodes n ON n.id = p.node_id""", "artifacts"))
def q_compare_prev_run(spark, sf):
    return L.compare_prev_run(X.artifacts(spark, sf), X.nodes(spark, sf))


@query("status_durations", W("""
    SELECT node_name, status, next_status, count(*) AS n_transitions,
           CAST(sum(epoch_us(next_ts) - epoch_us(ts)) AS BIGINT) AS total_duration_us
    FROM (SELECT node_name, status, ts, lead(status) OVER w AS next_status, lead(ts) OVER w AS next_ts
          FROM status_events WINDOW w AS (PARTITION BY node_name ORDER BY ts, id))
    GROUP BY ALL""", "status_events"))
def q_status_durations(spark, sf):
    return L.status_durations(X.status_events(spark, sf))


@query("snapshot_diff", W("""
    SELECT n.id, CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS change,
           o.state AS old_state, n.state AS new_state
    FROM snap_new n LEFT JOIN snap_old o ON o.id = n.id
    WHERE o.id IS NULL OR o.state IS DISTINCT FROM n.state""", "snap_old", "snap_new"))
def q_snapshot_diff(spark, sf):
    return L.snapshot_diff(X.snap_old(spark, sf), X.snap_new(spark, sf))


@query("validate_states", W(f"""
    SELECT 'artifact_state' AS domain, state AS value, count(*) AS n,
           coalesce(state IN ({_sql_list(S.ARTIFACT_STATES)}), false) AS valid FROM artifacts GROUP BY state
    UNION ALL
    SELECT 'status', status, count(*), coalesce(status IN ({_sql_list(S.STATUS_NAMES)}), false)
    FROM status_events GROUP BY status
    UNION ALL
    SELECT 'doc_store_state', state, count(*), coalesce(state IN ({_sql_list(S.DOC_STORE_STATES)}), false)
    FROM marks GROUP BY state
    UNION ALL
    SELECT 'log_level', upper(event_type), count(*), coalesce(upper(event_type) IN ({_sql_list(S.LOG_LEVELS)}), false)
    FROM events GROUP BY event_type""", "artifacts", "status_events", "marks"))
def q_validate_states(spark, sf):
    a = L.validate_values(X.artifacts(spark, sf), "state", S.ARTIFACT_STATES, "artifact_state")
    s = L.validate_values(X.status_events(spark, sf), "status", S.STATUS_NAMES, "status")
    # marks use the older document-store vocabulary check: "using"/"used" are not in it
    m = L.validate_values(X.marks(spark, sf), "state", S.DOC_STORE_STATES, "doc_store_state")
    # log lines carry their event's type as level: only ERROR is one
    lv = L.validate_values(load(spark, sf, "events").select(F.upper("event_type").alias("level")), "level", S.LOG_LEVELS, "log_level")
    return a.unionByName(s).unionByName(m).unionByName(lv)


@query("action_outcomes", W("""
    WITH per AS (SELECT m.run_id, n.node_name, max(m.metric_value) > 300 AS returned,
                        min(m.metric_value) < 0.05 AS raised
                 FROM metrics m JOIN nodes n ON m.node_id = n.id GROUP BY ALL)
    SELECT run_id, node_name,
           CASE WHEN raised THEN 'ERROR' WHEN coalesce(returned, false) THEN 'COMPLETE' ELSE 'FAILURE' END
             AS status,
           CASE WHEN NOT raised AND coalesce(returned, false) THEN 'SUCCESS' ELSE 'FAILURE' END AS signal,
           'CLEANUP' AS final_status
    FROM per""", "metrics"))
def q_action_outcomes(spark, sf):
    # one job execution per (run, action node): it "returned" true when its
    # largest logged value passed 300 and "raised" when one fell under 0.05
    m = X.metrics(spark, sf).join(X.nodes(spark, sf).select(F.col("id").alias("node_id"), "node_name"), "node_id")
    per = m.groupBy("run_id", "node_name").agg((F.max("metric_value") > 300).alias("returned"),
                                               (F.min("metric_value") < 0.05).alias("raised"))
    return L.action_outcomes(per)


# ---------------------------------------------------------------- writes ---

@query("register_nodes", W("""
    WITH r AS (SELECT g.node_name, g.base_type, n.node_name IS NOT NULL AS known,
                      row_number() OVER (PARTITION BY g.node_name ORDER BY g.base_type) AS k
               FROM graph_nodes g LEFT JOIN (SELECT DISTINCT node_name FROM nodes) n USING (node_name)),
    m AS (SELECT max(id) AS m FROM nodes)
    SELECT CASE WHEN NOT known AND k = 1 THEN CAST(m.m + row_number() OVER (PARTITION BY NOT known AND k = 1 ORDER BY node_name)
                AS BIGINT) END AS id, node_name, base_type AS node_type, base_type, NOT known AND k = 1 AS accepted,
           CASE WHEN known THEN 'already recorded' WHEN k > 1 THEN 'repeated in batch' END AS reason
    FROM r, m""", "nodes", "graph_nodes"))
def q_register_nodes(spark, sf):
    g = X.graph_nodes(spark, sf).select("node_name", F.col("base_type").alias("node_type"), "base_type")
    return K.register_nodes(X.nodes(spark, sf), g).drop("init_time")


_NEW_TXT = """SELECT source AS node_name, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS location,
                     sha256(text) AS hash, 'new' AS state, CAST(NULL AS BIGINT) AS run_id, n_chars AS size FROM documents"""
_ADMIT = """
    r AS (SELECT new.*, n.id AS node_id, ex.location IS NOT NULL AS known,
                 row_number() OVER (PARTITION BY n.id, new.location ORDER BY new.hash, new.state, new.run_id NULLS FIRST, new.size) AS k
          FROM new LEFT JOIN nodes n USING (node_name)
          LEFT JOIN (SELECT DISTINCT node_id, location FROM artifacts) ex ON ex.node_id = n.id AND ex.location = new.location),
    ok AS (SELECT *, node_id IS NOT NULL AND NOT known AND k = 1 AS accepted FROM r),
    m AS (SELECT max(id) AS m FROM artifacts)
    SELECT CASE WHEN accepted THEN CAST(m.m + row_number() OVER (PARTITION BY accepted ORDER BY node_name, location) AS BIGINT)
                END AS id, node_id, node_name, location, state, run_id, hash, size, accepted,
           CASE WHEN node_id IS NULL THEN 'unknown node' WHEN known THEN 'already recorded' WHEN k > 1 THEN 'repeated in batch'
                END AS reason
    FROM ok, m"""
_INSERTED = ["id", "node_id", "node_name", "location", "state", "run_id", "hash", "size", "accepted", "reason"]


@query("insert_artifacts", W(f"""
    WITH doc AS ({_NEW_TXT}),
    new AS (SELECT * FROM doc UNION ALL SELECT * FROM doc WHERE size % 10 = 0
            UNION ALL SELECT * REPLACE (sha256(hash) AS hash) FROM doc WHERE size % 7 = 0
            UNION ALL SELECT * REPLACE ('ghost' AS node_name) FROM doc WHERE size % 11 = 0
            UNION ALL SELECT * REPLACE ('produced' AS state, 3 AS run_id, location || '.out' AS location) FROM doc WHERE size % 5 = 0),
    {_ADMIT}""", "artifacts"))
def q_insert_artifacts(spark, sf):
    # every document recorded again as a .txt file, with repeated rows, keys
    # with two hashes, an unknown node and files that a run produced
    d = load(spark, sf, "documents")
    new = d.select(F.col("source").alias("node_name"),
                   F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("location"),
                   F.sha2("text", 256).alias("hash"), F.lit(S.HASH_ALGORITHM).alias("hash_algorithm"),
                   F.lit("new").alias("state"), F.lit(None).cast("long").alias("run_id"),
                   F.col("n_chars").alias("size"), F.lit("text/plain").alias("content_type"))
    of = lambda k: new.where(F.col("size") % k == 0)
    new = (new.unionByName(of(10)).unionByName(of(7).withColumn("hash", F.sha2("hash", 256)))
           .unionByName(of(11).withColumn("node_name", F.lit("ghost")))
           .unionByName(of(5).withColumns({"state": F.lit("produced"), "run_id": F.lit(3).cast("long"),
                                           "location": F.concat("location", F.lit(".out"))})))
    return K.insert_artifacts(X.artifacts(spark, sf), X.nodes(spark, sf), new).select(*_INSERTED)


@query("merge_catalog", W(f"""
    WITH new AS (SELECT 'src0' AS node_name, location, hash, 'new' AS state, run_id, size FROM artifacts
                 UNION ALL SELECT 'src0', location, hash, 'new', run_id, size FROM artifacts WHERE id % 9 = 0),
    {_ADMIT}""", "artifacts"))
def q_merge_catalog(spark, sf):
    # another store's whole artifact table, some of it twice, merged under node src0
    a = X.artifacts(spark, sf)
    return K.merge_catalog(a, X.nodes(spark, sf), a.unionByName(a.where("id % 9 = 0")), "src0").select(*_INSERTED)


@query("log_metrics", """
    SELECT l_orderkey, l_linenumber, metric_name, metric_value FROM
      (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
      UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (l_quantity, l_extendedprice, l_discount, l_tax))""")
def q_log_metrics(spark, sf):
    li = load(spark, sf, "lineitem")
    return K.log_metrics(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("log_params", """
    SELECT event_id, k AS param_name, json_extract_string(props, '$.' || k) AS param_value
    FROM (SELECT event_id, props, unnest(json_keys(CAST(props AS JSON))) AS k FROM events)""")
def q_log_params(spark, sf):
    ev = load(spark, sf, "events")
    return K.json_kwargs_to_long(ev, ["event_id"], "props", "param_name", "param_value")


@query("log_tags", """
    SELECT o_orderkey, tag_name, tag_value FROM
      (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)
      UNPIVOT INCLUDE NULLS (tag_value FOR tag_name IN (o_orderstatus, o_orderpriority))""")
def q_log_tags(spark, sf):
    od = load(spark, sf, "orders")
    return K.log_tags(od, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("tag_artifacts", W("""
    WITH req AS (SELECT d.source AS node_name, d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS location,
                        CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic
                 FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    lng AS (SELECT * FROM req UNPIVOT INCLUDE NULLS (tag_value FOR tag_name IN (quality, toxic))),
    a AS (SELECT n.node_name, a.location, min(a.id) AS artifact_id
          FROM artifacts a JOIN nodes n ON a.node_id = n.id GROUP BY ALL)
    SELECT lng.node_name, lng.location, a.artifact_id, lng.tag_name, lng.tag_value,
           a.artifact_id IS NOT NULL AS accepted
    FROM lng LEFT JOIN a USING (node_name, location)""", "artifacts"))
def q_tag_artifacts(spark, sf):
    # tag the .txt artifact of every labelled document; missing ones are refused
    d = load(spark, sf, "documents")
    lb = load(spark, sf, "labels")
    req = lb.join(d, "doc_id").select(
        F.col("source").alias("node_name"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("location"),
        "quality", "toxic")
    return K.tag_artifacts(X.artifacts(spark, sf), X.nodes(spark, sf), req, ["quality", "toxic"])


@query("card_links", W("""
    SELECT regexp_replace(location, '\\.md$', '.bin') AS location, 'model_card_path' AS tag_name,
           location AS tag_value FROM artifacts WHERE location LIKE '%.md'
    UNION ALL
    SELECT location, 'model_path', regexp_replace(location, '\\.md$', '.bin')
    FROM artifacts WHERE location LIKE '%.md'""", "artifacts"))
def q_card_links(spark, sf):
    # every markdown artifact is the card of the model file with the same stem
    a = X.artifacts(spark, sf).where(F.col("location").endswith(".md"))
    links = a.select(F.regexp_replace("location", r"\.md$", ".bin").alias("subject"),
                     F.col("location").alias("card"))
    return K.card_links(links, "model_path", "model_card_path")


@query("doc_query", """
    SELECT event_id AS id, event_type AS type, props->>'k' AS k FROM events
    WHERE event_type = 'purchase' AND props->>'k' = '42'""")
def q_doc_query(spark, sf):
    d = K.doc_query(X.doc_store(spark, sf), "purchase", k=42)
    return d.select("id", "type", F.expr("variant_get(payload, '$.k', 'string')").alias("k"))


@query("doc_count", """
    SELECT event_type AS type, count(*) AS n FROM events WHERE props->>'k' = '42' GROUP BY event_type""")
def q_doc_count(spark, sf):
    return K.doc_query(X.doc_store(spark, sf), None, k=42).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("doc_update", """
    WITH u AS (SELECT *, coalesce(event_type = 'error' AND props->>'k' = '42', false) AS hit FROM events)
    SELECT event_id AS id, event_type AS type, props->>'k' AS k,
           CASE WHEN hit THEN 'triaged' ELSE props->>'status' END AS status,
           CASE WHEN hit THEN 3 ELSE CAST(props->>'level' AS BIGINT) END AS level, hit AS updated
    FROM u""")
def q_doc_update(spark, sf):
    d = K.doc_update(X.doc_store(spark, sf), {"status": "triaged", "level": 3}, "error", k=42)
    get = lambda k, t: F.try_variant_get("payload", f"$.{k}", t).alias(k)
    return d.select("id", "type", get("k", "string"), get("status", "string"), get("level", "bigint"), "updated")


_STARTS = [dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)]
_END = dt.datetime(2024, 1, 15)


@query("doc_lifecycle", f"""
    WITH e AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'trigger' ELSE 'artifact' END AS type, event_id % 7 = 0 AS used,
                      CASE WHEN ts < TIMESTAMP '{_STARTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{_STARTS[1]}' THEN 1 END AS wave
               FROM events WHERE event_type IN ('view', 'click', 'error'))
    SELECT id, type, CASE WHEN type = 'artifact' THEN CASE WHEN used THEN 'old' WHEN wave = 0 THEN 'old' WHEN wave = 1 THEN 'current' ELSE 'new' END END AS state,
           CASE WHEN type = 'artifact' AND NOT used THEN wave::BIGINT END AS run_id,
           CASE WHEN type = 'artifact' AND NOT used AND wave = 0 THEN '{_END.isoformat()}' END AS end_time,
           CASE WHEN type = 'trigger' THEN wave::BIGINT END AS run_triggered
    FROM e
    UNION ALL SELECT -1, 'run', NULL, 0, '{_END.isoformat()}', NULL
    UNION ALL SELECT -2, 'run', NULL, 1, NULL, NULL""")
def q_doc_lifecycle(spark, sf):
    from ..session import fresh_scratch
    ev = load(spark, sf, "events").where(F.col("event_type").isin("view", "click", "error"))
    trigger = F.col("event_type") == "error"
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(trigger, F.concat(F.lit('{"run_triggered": null, "trigger_time": "'), iso, F.lit('"}'))).otherwise(F.concat(
        F.lit('{"state": "'), F.when(F.col("event_id") % 7 == 0, "old").otherwise("new"),
        F.when(F.col("event_id") % 2 == 0, F.lit('", "run_id": null}')).otherwise(F.lit('"}'))))        # a null field, or none
    docs = ev.select("ts", F.col("event_id").alias("id"), F.when(trigger, "trigger").otherwise("artifact").alias("type"),
                     F.parse_json(text).alias("payload"))
    runs = spark.createDataFrame([(-1 - k, "run", '{"run_id": %d, "start_time": "%s"}' % (k, t.isoformat())) for k, t in enumerate(_STARTS)],
                                 "id long, type string, payload string").withColumn("payload", F.parse_json("payload"))
    path = fresh_scratch(spark, "doc-log")

    def now(k, log):
        """The store when run k starts or goes on."""
        there = docs.where(F.col("ts") < F.lit(_STARTS[k])).drop("ts").unionByName(runs.where(F.col("id") >= -1 - k))
        return DS.fold_log(there, log)

    none = spark.createDataFrame([], DS.LOG_SCHEMA)
    DS.start_run_log(now(0, none), 0, _STARTS[0], 1).write.mode("append").parquet(path)
    log = lambda: spark.read.schema(DS.LOG_SCHEMA).parquet(path)
    DS.end_run_log(now(0, log()), _END, 2).write.mode("append").parquet(path)
    DS.start_run_log(now(1, log()), 1, _STARTS[1], 3).write.mode("append").parquet(path)
    end = DS.fold_log(docs.drop("ts").unionByName(runs), log())
    get = lambda k, t: F.try_variant_get("payload", f"$.{k}", t).alias(k)
    return end.select("id", "type", get("state", "string"), get("run_id", "bigint"), get("end_time", "string"), get("run_triggered", "bigint"))
