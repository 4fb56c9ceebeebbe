"""File-discovery and file-reading queries (S-1..S-8, K-17, K-18, X-7).

Discovery, verification, audit and loader queries scan stand-in trees
written once from ``documents`` into the shared checkpoint folder (see
``sources.standin``).  The two card queries write their cards with the K-18
writer into a fresh folder on every run and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cards as CD
from ..session import fresh_scratch
from ..sources import files as FS
from ..sources import fixtures as X
from ..sources import standin as ST
from .card_queries import _SPLIT_SQL, _META_SQL, _cards, _flat_entries
from .registry import query

W = X.with_fixtures
_EXT = "CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.txt' END"
_LOC = f"lang || '/' || CAST(doc_id AS VARCHAR) || {_EXT}"


def _catalog_keys(spark, sf):
    a = X.artifacts(spark, sf)
    n = X.nodes(spark, sf).select(F.col("id").alias("node_id"), "node_name")
    return a.join(n, "node_id")


@query("artifact_scan", f"""
    SELECT source AS node_name, {_LOC} AS location, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash
    FROM documents""")
def q_artifact_scan(spark, sf):
    root = ST.document_tree(spark, sf)
    return FS.scan_artifacts(spark, root).select("node_name", "location", "size", "hash")


@query("new_artifacts", W(f"""
    SELECT d.source AS node_name, {_LOC} AS location, CAST(strlen(d.text) AS BIGINT) AS size, sha256(d.text) AS hash
    FROM documents d JOIN artifacts a ON a.id = d.doc_id WHERE a.state = 'new'""", "artifacts"))
def q_new_artifacts(spark, sf):
    # the catalog as it stood before this pass: everything but its 'new' rows
    known = _catalog_keys(spark, sf).where(F.col("state") != "new")
    root = ST.document_tree(spark, sf)
    return FS.new_artifacts(spark, root, known).select("node_name", "location", "size", "hash")


@query("verify_artifacts", W(f"""
    WITH cat AS (SELECT n.node_name, a.location, a.hash AS expected_hash
                 FROM artifacts a JOIN nodes n ON a.node_id = n.id),
    act AS (SELECT source AS node_name,
                   CASE WHEN doc_id % 10 = 0 THEN lang || '/' || CAST(doc_id AS VARCHAR) || '.bak' ELSE {_LOC} END
                     AS location,
                   sha256(CASE WHEN doc_id % 7 = 0 AND doc_id % 10 <> 0 THEN text || ' [edited]' ELSE text END)
                     AS actual_hash
            FROM documents)
    SELECT coalesce(cat.node_name, act.node_name) AS node_name, coalesce(cat.location, act.location) AS location,
           expected_hash, actual_hash,
           CASE WHEN expected_hash IS NULL THEN 'untracked' WHEN actual_hash IS NULL THEN 'missing'
                WHEN actual_hash = expected_hash THEN 'ok' ELSE 'mismatch' END AS status
    FROM cat FULL OUTER JOIN act ON cat.node_name = act.node_name AND cat.location = act.location""",
                             "artifacts"))
def q_verify_artifacts(spark, sf):
    # the catalog checked against the transferred copy of its files
    actual = FS.scan_artifacts(spark, ST.copied_tree(spark, sf))
    return FS.verify_artifacts(actual, _catalog_keys(spark, sf))


@query("transfer_audit", f"""
    WITH s AS (SELECT source || '/' || {_LOC} AS location, sha256(text) AS source_hash FROM documents),
    t AS (SELECT source || '/' || CASE WHEN doc_id % 10 = 0 THEN lang || '/' || CAST(doc_id AS VARCHAR) || '.bak'
                                       ELSE {_LOC} END AS location,
                 sha256(CASE WHEN doc_id % 7 = 0 AND doc_id % 10 <> 0 THEN text || ' [edited]' ELSE text END)
                   AS target_hash FROM documents)
    SELECT coalesce(s.location, t.location) AS location, source_hash, target_hash,
           CASE WHEN source_hash IS NULL THEN 'extra' WHEN target_hash IS NULL THEN 'missing'
                WHEN source_hash = target_hash THEN 'copied' ELSE 'mismatch' END AS status
    FROM s FULL OUTER JOIN t USING (location)""")
def q_transfer_audit(spark, sf):
    src = FS.scan_artifacts(spark, ST.document_tree(spark, sf), node_level=False)
    dst = FS.scan_artifacts(spark, ST.copied_tree(spark, sf), node_level=False)
    return FS.transfer_audit(src, dst)


@query("object_listing", f"""
    SELECT source || '/' || {_LOC} AS key, CAST(strlen(text) AS BIGINT) AS size FROM documents""")
def q_object_listing(spark, sf):
    return FS.object_listing(spark, ST.document_tree(spark, sf))


@query("artifact_text", f"SELECT source AS node_name, {_LOC} AS location, text AS content FROM documents")
def q_artifact_text(spark, sf):
    return FS.artifact_text(spark, ST.document_tree(spark, sf))


@query("dataset_cards", W("""
    SELECT n.node_name AS name, count(*) AS n_distribution, 'https://mlcommons.org/croissant/1.0' AS conformsTo,
           '2024-02-01' AS datePublished
    FROM artifacts a JOIN nodes n ON a.node_id = n.id GROUP BY n.node_name""", "artifacts"))
def q_dataset_cards(spark, sf):
    # build JSON-LD cards, write one file per card, read them back
    cards = CD.dataset_cards(X.artifacts(spark, sf), X.nodes(spark, sf), "2024-02-01")
    docs = CD.card_to_jsonld(cards).select(F.concat_ws("-", "name", "part").alias("card_id"), F.col("json").alias("text"))
    root = fresh_scratch(spark, "dataset-cards")
    CD.write_cards(docs, root, ext=".jsonld")
    back = CD.card_from_jsonld(FS.read_dataset_cards(spark, root, CD.JSONLD_SCHEMA))
    return back.groupBy("name", "conformsTo", "datePublished").agg(
        F.sum(F.size("distribution").cast("long")).alias("n_distribution"))


@query("card_files_front_matter", W("WITH " + _META_SQL + ",\n " + _SPLIT_SQL + " SELECT * FROM ent", "artifacts"))
def q_card_files_front_matter(spark, sf):
    # rendered cards written as .md files, read back whole, front matter parsed
    root = fresh_scratch(spark, "model-cards")
    CD.write_cards(_cards(spark, sf), root, ext=".md")
    return _flat_entries(CD.header_entries(CD.split_front_matter(FS.read_card_texts(spark, root))))


def _count_lines_words(path, content):
    text = bytes(content).decode("utf-8")
    return {"path": path, "n_lines": len(text.splitlines()), "n_words": len(text.split())}


# The loader is user Python (str.splitlines / str.split); on this corpus,
# whose only line break is LF, the SQL below counts the same.
@query("custom_load", f"""
    SELECT source || '/' || {_LOC} AS location,
           CAST(length(text) - length(replace(text, chr(10), '')) +
                CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
           CAST(CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0
                ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS BIGINT) AS n_words
    FROM documents""")
def q_custom_load(spark, sf):
    root = ST.document_tree(spark, sf)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_words", T.LongType())])
    out = FS.custom_load(FS.list_files(spark, root), _count_lines_words, schema)
    rel = FS.relative_location("path", root)
    return out.select(rel.alias("location"), "n_lines", "n_words")
