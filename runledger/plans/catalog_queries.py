"""Catalog queries (P-*, J-1, J-2, A-1, O-1) over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import fixtures as X
from ..sources.tables import load
from .registry import query

W = X.with_fixtures


@query("runs", W("SELECT run_id, start_time, end_time, hash FROM runs", "runs"))
def q_runs(spark, sf):
    return C.runs_view(X.runs(spark, sf))


@query("nodes_info", W("SELECT id, node_name, node_type, base_type FROM nodes "
                       "WHERE node_name LIKE 'src%'", "nodes"))
def q_nodes_info(spark, sf):
    # name filter form; every resource node whose name starts with "src"
    n = X.nodes(spark, sf)
    return C.nodes_info(n).where(F.col("node_name").startswith("src"))


@query("node_ids", W("""
    SELECT r.node_name, m.id, m.id IS NOT NULL AS found
    FROM (SELECT DISTINCT node_name FROM status_events
          UNION SELECT 'region:' || r_name FROM region) r
    LEFT JOIN (SELECT node_name, min(id) AS id FROM nodes GROUP BY node_name) m USING (node_name)""",
                     "nodes", "status_events"))
def q_node_ids(spark, sf):
    # requests: every node that reported a status, plus region names that are
    # not catalog nodes (they must come back with found = false)
    req = (X.status_events(spark, sf).select("node_name")
           .unionByName(load(spark, sf, "region").select(F.concat(F.lit("region:"), "r_name").alias("node_name"))))
    return C.node_ids(X.nodes(spark, sf), req)


@query("entries_exist", W("""
    SELECT r.node_name, r.location, EXISTS (SELECT 1 FROM artifacts a JOIN nodes n ON a.node_id = n.id
                                            WHERE n.node_name = r.node_name AND a.location = r.location) AS "exists"
    FROM (SELECT DISTINCT source AS node_name, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS location
          FROM documents) r""", "artifacts"))
def q_entries_exist(spark, sf):
    # does a .txt artifact exist for every document?
    req = load(spark, sf, "documents").select(
        F.col("source").alias("node_name"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("location")).distinct()
    return C.entries_exist(X.artifacts(spark, sf), X.nodes(spark, sf), req)


_ENTRIES_SQL = """SELECT a.id, a.run_id, a.location, a.created_at, a.state, a.hash,
       a.hash_algorithm, a.size, a.content_type, n.node_name
FROM artifacts a JOIN nodes n ON a.node_id = n.id"""


@query("entries", W(_ENTRIES_SQL, "artifacts"))
def q_entries(spark, sf):
    return C.entries(X.artifacts(spark, sf), X.nodes(spark, sf))


@query("entries_filtered", W(_ENTRIES_SQL + " WHERE n.node_name = 'src3' AND a.state = 'used' AND a.run_id = 3",
                             "artifacts"))
def q_entries_filtered(spark, sf):
    return C.entries(X.artifacts(spark, sf), X.nodes(spark, sf), node_name="src3", state="used", run_id=3)


@query("list_artifacts", W("SELECT n.node_name, a.location FROM artifacts a JOIN nodes n ON a.node_id = n.id "
                           "WHERE a.state = 'new'", "artifacts"))
def q_list_artifacts(spark, sf):
    return C.list_artifacts(X.artifacts(spark, sf), X.nodes(spark, sf), state="new")


@query("artifact_by_id", W("""
    SELECT r.id, e.run_id, e.location, e.state, e.hash, e.hash_algorithm, e.size, e.content_type, e.node_name,
           e.location IS NOT NULL AS found
    FROM (SELECT DISTINCT doc_id AS id FROM labels) r
    LEFT JOIN (SELECT a.*, n.node_name FROM artifacts a JOIN nodes n ON a.node_id = n.id) e ON e.id = r.id""",
                           "artifacts"))
def q_artifact_by_id(spark, sf):
    # every labelled document is looked up by id
    ids = load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return C.artifact_by_id(X.artifacts(spark, sf), X.nodes(spark, sf), ids).select(
        "id", "run_id", "location", "state", "hash", "hash_algorithm", "size", "content_type",
        "node_name", "found")


@query("artifact_hash", W("""
    SELECT r.node_name, r.location, b.id, b.hash
    FROM (SELECT DISTINCT source AS node_name,
                 lang || '/' || CAST(doc_id AS VARCHAR) ||
                   CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.txt' END AS location
          FROM documents) r
    LEFT JOIN (SELECT n.node_name, a.location, arg_min(a.hash, a.id) AS hash, min(a.id) AS id
               FROM artifacts a JOIN nodes n ON a.node_id = n.id GROUP BY ALL) b
      USING (node_name, location)""", "artifacts"))
def q_artifact_hash(spark, sf):
    d = load(spark, sf, "documents")
    ext = (F.when(F.col("doc_id") % 4 == 0, ".json").when(F.col("doc_id") % 4 == 1, ".md").otherwise(".txt"))
    req = d.select(F.col("source").alias("node_name"),
                   F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("location"))
    return C.artifact_hash(X.artifacts(spark, sf), X.nodes(spark, sf), req)


@query("artifacts_by_suffix", W("""
    SELECT a.id, n.node_name, a.location, a.location LIKE '%.json' AS is_card,
           NOT (a.location LIKE '%.md') AS is_model, a.location LIKE '%.txt' AS is_text_model
    FROM artifacts a JOIN nodes n ON a.node_id = n.id""", "artifacts"))
def q_artifacts_by_suffix(spark, sf):
    return C.artifacts_by_suffix(X.artifacts(spark, sf), X.nodes(spark, sf))


@query("metrics", W("SELECT m.id, m.run_id, m.metric_name, m.metric_value, n.node_name "
                    "FROM metrics m JOIN nodes n ON m.node_id = n.id", "metrics"))
def q_metrics(spark, sf):
    return C.metrics_view(X.metrics(spark, sf), X.nodes(spark, sf))


@query("params", W("SELECT p.id, p.run_id, p.param_name, p.param_value, n.node_name "
                   "FROM params p JOIN nodes n ON p.node_id = n.id", "params"))
def q_params(spark, sf):
    return C.params_view(X.params(spark, sf), X.nodes(spark, sf))


@query("tags", W("""
    SELECT t.id, t.run_id, t.tag_name, t.tag_value, n.node_name
    FROM (SELECT id, run_id, 1 + CAST(id % 20 AS BIGINT) AS node_id, tag_name, tag_value FROM tags) t
    JOIN nodes n ON t.node_id = n.id""", "tags", "nodes"))
def q_tags(spark, sf):
    # tags are attributed to a node by id bucket so the join has work to do
    t = X.tags(spark, sf).withColumn("node_id", (1 + F.col("id") % 20).cast("long"))
    return C.tags_view(t, X.nodes(spark, sf))


@query("triggers", W("SELECT t.id, t.run_triggered, t.trigger_time, t.message, n.node_name "
                     "FROM triggers t JOIN nodes n ON t.node_id = n.id", "triggers"))
def q_triggers(spark, sf):
    return C.triggers_view(X.triggers(spark, sf), X.nodes(spark, sf))


@query("artifact_tags", W("""
    SELECT a.id AS artifact_id, a.location, t.id AS tag_id, t.tag_name, t.tag_value
    FROM artifacts a JOIN artifact_tag_links l ON l.artifact_id = a.id JOIN tags t ON t.id = l.tag_id""",
                          "artifacts", "artifact_tag_links", "tags"))
def q_artifact_tags(spark, sf):
    return C.artifact_tags(X.artifacts(spark, sf), X.artifact_tag_links(spark, sf), X.tags(spark, sf)).drop("tag")


@query("num_entries", W("""
    SELECT n.node_name, coalesce(a.state, 'all') AS state, count(*) AS num_entries
    FROM artifacts a JOIN nodes n ON a.node_id = n.id
    GROUP BY GROUPING SETS ((n.node_name, a.state), (n.node_name))""", "artifacts"))
def q_num_entries(spark, sf):
    return C.num_entries(X.artifacts(spark, sf), X.nodes(spark, sf))


@query("recent_artifacts", W("""
    SELECT node_name, id, location, state, rank FROM (
      SELECT n.node_name, a.id, a.location, a.state,
             CAST(row_number() OVER (PARTITION BY a.node_id ORDER BY a.id DESC) AS BIGINT) AS rank
      FROM artifacts a JOIN nodes n ON a.node_id = n.id) WHERE rank <= 10""", "artifacts"))
def q_recent_artifacts(spark, sf):
    return C.recent_artifacts(X.artifacts(spark, sf), X.nodes(spark, sf), k=10)
