"""Scalar-function and report-view queries (N-*, P-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import fingerprint as FP
from ..operators import reports as RP
from ..sources import fixtures as X
from ..sources.tables import load
from .registry import query

W = X.with_fixtures
_FMT = "'%m/%d/%Y, %H:%M:%S'"


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", FP.content_hash("text").alias("content_hash"))


@query("path_parts", W("""
    SELECT id, location, split_part(location, '/', -1) AS base_name,
           regexp_extract(location, '^(.*)/', 1) AS dir_name FROM artifacts""", "artifacts"))
def q_path_parts(spark, sf):
    a = X.artifacts(spark, sf)
    return a.select("id", "location", T.base_name("location").alias("base_name"),
                    T.dir_name("location").alias("dir_name"))


@query("report_runs", W(f"""
    SELECT run_id, strftime(start_time, {_FMT}) AS start_time, strftime(end_time, {_FMT}) AS end_time,
           hash AS run_hash FROM runs""", "runs"))
def q_report_runs(spark, sf):
    return RP.report_runs(X.runs(spark, sf))


@query("report_samples", W(f"""
    SELECT a.id AS sample_id, a.run_id, n.node_name, strftime(a.created_at, {_FMT}) AS created_at,
           a.location, a.state, a.hash, a.hash_algorithm
    FROM artifacts a JOIN nodes n ON a.node_id = n.id""", "artifacts"))
def q_report_samples(spark, sf):
    return RP.report_samples(C.entries(X.artifacts(spark, sf), X.nodes(spark, sf)))


@query("report_metrics", W("""
    SELECT m.id AS entry_id, m.run_id, n.node_name, m.metric_name AS metric, m.metric_value AS value
    FROM metrics m JOIN nodes n ON m.node_id = n.id""", "metrics"))
def q_report_metrics(spark, sf):
    return RP.report_metrics(C.metrics_view(X.metrics(spark, sf), X.nodes(spark, sf)))


@query("report_params", W("""
    SELECT p.id AS entry_id, p.run_id, n.node_name, p.param_name, p.param_value AS value
    FROM params p JOIN nodes n ON p.node_id = n.id""", "params"))
def q_report_params(spark, sf):
    return RP.report_params(C.params_view(X.params(spark, sf), X.nodes(spark, sf)))


@query("report_tags", W("""
    SELECT t.id AS entry_id, t.run_id, n.node_name, t.tag_name, t.tag_value AS value
    FROM (SELECT id, run_id, 1 + CAST(id % 20 AS BIGINT) AS node_id, tag_name, tag_value FROM tags) t
    JOIN nodes n ON t.node_id = n.id""", "tags", "nodes"))
def q_report_tags(spark, sf):
    t = X.tags(spark, sf).withColumn("node_id", (1 + F.col("id") % 20).cast("long"))
    return RP.report_tags(C.tags_view(t, X.nodes(spark, sf)))


@query("report_triggers", W(f"""
    SELECT t.id AS trigger_id, t.run_triggered, n.node_name AS triggered_by,
           strftime(t.trigger_time, {_FMT}) AS trigger_time, t.message
    FROM triggers t JOIN nodes n ON t.node_id = n.id""", "triggers"))
def q_report_triggers(spark, sf):
    return RP.report_triggers(C.triggers_view(X.triggers(spark, sf), X.nodes(spark, sf)))


@query("iso_roundtrip", """
    SELECT event_id,
           CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
           true AS roundtrip_ok
    FROM events""")
def q_iso_roundtrip(spark, sf):
    ev = load(spark, sf, "events")
    iso = T.iso_format("ts")
    return ev.select("event_id", iso.alias("iso"), (T.from_iso(iso) == F.col("ts")).alias("roundtrip_ok"))


@query("status_label", W("""
    SELECT id, status, regexp_replace(lower(status), '_', ' ') AS label FROM status_events""", "status_events"))
def q_status_label(spark, sf):
    s = X.status_events(spark, sf)
    return s.select("id", "status", T.status_label("status").alias("label"))


@query("line_endings", """
    SELECT doc_id,
           CASE WHEN cr + lf = 0 THEN NULL WHEN crlf = cr AND crlf = lf THEN 'CRLF'
                WHEN cr > lf THEN 'CR' ELSE 'LF' END AS line_ending
    FROM (SELECT doc_id, length(text) - length(replace(text, chr(13), '')) AS cr,
                 length(text) - length(replace(text, chr(10), '')) AS lf,
                 (length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 AS crlf
          FROM documents)""")
def q_line_endings(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", T.line_ending_name("text").alias("line_ending"))


# Python's str.upper() and Java's toUpperCase() both use full case mapping
# (German sharp s becomes "SS"); DuckDB's upper() gives the capital sharp s, so the oracle
# applies that one mapping itself.
@query("preprocess_text", """
    SELECT doc_id, sha256(upper(replace(text, 'ß', 'ss'))) AS upper_hash,
           length(upper(replace(text, 'ß', 'ss'))) AS upper_len FROM documents""")
def q_preprocess_text(spark, sf):
    d = load(spark, sf, "documents")
    up = T.preprocess_upper("text")
    return d.select("doc_id", F.sha2(up, 256).alias("upper_hash"), F.length(up).cast("long").alias("upper_len"))


@query("url_parts", """
    SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme,
           regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS authority,
           regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
           string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/')[-1] AS last_segment,
           coalesce(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) = 'https', false) AS is_https
    FROM pages""")
def q_url_parts(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", T.url_scheme("url").alias("scheme"), T.url_authority("url").alias("authority"),
                    T.url_path("url").alias("path"), T.url_last_segment("url").alias("last_segment"),
                    T.is_https("url").alias("is_https"))
