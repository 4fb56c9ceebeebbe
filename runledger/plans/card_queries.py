"""Card and evaluation-result queries (A-8, A-9, C-1..C-7, N-8..N-12, N-19, U-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import cards as CD
from ..operators import fingerprint as FP
from ..sources import fixtures as X
from ..sources.tables import load
from .registry import query

W = X.with_fixtures
_EVAL_COLS = ["model_name", "task_type", "task_name", "dataset_type", "dataset_name", "dataset_config",
              "dataset_split", "dataset_revision", "dataset_args", "metric_type", "metric_value", "metric_name",
              "metric_config", "metric_args", "verified", "verify_token", "source_name", "source_url"]


@query("model_index_build", W("""
    SELECT model_name, task_type, dataset_type, dataset_config, dataset_split, dataset_revision,
           min(seq) AS first_seq, arg_min(task_name, seq) AS task_name, arg_min(dataset_name, seq) AS dataset_name,
           arg_min(source_name, seq) AS source_name, arg_min(source_url, seq) AS source_url,
           count(*) AS n_metrics, array_to_string(list_sort(list_distinct(list(metric_type))), ',') AS metric_types
    FROM eval_results GROUP BY ALL""", "eval_results"))
def q_model_index_build(spark, sf):
    return CD.model_index_summary(X.eval_results(spark, sf))


def _j(field: str, expr: str) -> str:
    """DuckDB: '"field":<json>' or NULL when the value is NULL (to_json drops NULL fields)."""
    return f"""CASE WHEN {expr} IS NOT NULL THEN '"{field}":' || to_json({expr}) END"""


_MODEL_INDEX_JSON_SQL = f"""
    WITH g AS (
      SELECT model_name, task_type, dataset_type, dataset_config, dataset_split, dataset_revision,
             min(seq) AS first_seq, arg_min(task_name, seq) AS tn, arg_min(dataset_name, seq) AS dn,
             arg_min(source_name, seq) AS sn, arg_min(source_url, seq) AS su, arg_min(dataset_args, seq) AS da,
             string_agg('{{' || concat_ws(',', {_j('type', 'metric_type')},
                          CASE WHEN metric_value IS NOT NULL THEN '"value":' || CAST(metric_value AS VARCHAR) END,
                          {_j('name', 'metric_name')}, {_j('config', 'metric_config')}, '"args":' || metric_args,
                          {_j('verified', 'verified')}, {_j('verifyToken', 'verify_token')}) || '}}', ','
                        ORDER BY seq) AS metrics
      FROM eval_results GROUP BY ALL),
    r AS (
      SELECT model_name, first_seq,
             '{{' || concat_ws(',',
                 '"task":{{' || concat_ws(',', {_j('type', 'task_type')}, {_j('name', 'tn')}) || '}}',
                 '"dataset":{{' || concat_ws(',', {_j('name', 'dn')}, {_j('type', 'dataset_type')},
                                            {_j('config', 'dataset_config')}, {_j('split', 'dataset_split')},
                                            {_j('revision', 'dataset_revision')}, '"args":' || da) || '}}',
                 '"metrics":[' || metrics || ']',
                 CASE WHEN su IS NOT NULL THEN '"source":{{' || concat_ws(',', {_j('url', 'su')}, {_j('name', 'sn')})
                      || '}}' END) || '}}' AS result
      FROM g)
    SELECT model_name AS name,
           '[{{"name":' || to_json(model_name) || ',"results":[' || string_agg(result, ',' ORDER BY first_seq) || ']}}]'
             AS model_index
    FROM r GROUP BY model_name"""


@query("model_index_json", W(_MODEL_INDEX_JSON_SQL, "eval_results"))
def q_model_index_json(spark, sf):
    return CD.model_index_json(CD.model_index_build(X.eval_results(spark, sf)))


# The model index keeps a source only when it has a URL, so a source name
# without a URL does not survive build -> flatten (the reference does the same).
@query("model_index_flatten", W("SELECT " + ", ".join(
    "CASE WHEN source_url IS NOT NULL THEN source_name END AS source_name" if c == "source_name" else c
    for c in _EVAL_COLS) + " FROM eval_results", "eval_results"))
def q_model_index_flatten(spark, sf):
    # build the nested index from the flat results, then explode it back
    return CD.model_index_flatten(CD.model_index_build(X.eval_results(spark, sf))).select(*_EVAL_COLS)


_CMP = ", ".join(CD.EVAL_COMPARE)


@query("eval_conflicts", W(f"""
    SELECT seq, first_seq, n_in_group, n_values FROM (
      SELECT seq, min(seq) OVER w AS first_seq, count(*) OVER w AS n_in_group,
             count(DISTINCT metric_value) OVER w AS n_values
      FROM eval_results WINDOW w AS (PARTITION BY {_CMP}))
    WHERE n_in_group > 1""", "eval_results"))
def q_eval_conflicts(spark, sf):
    return CD.eval_conflicts(X.eval_results(spark, sf))


@query("eval_violations", W("""
    WITH e AS (SELECT * REPLACE (CASE WHEN seq % 5 <> 1 THEN model_name END AS model_name,
                                 CASE WHEN seq % 7 <> 1 THEN dataset_name END AS dataset_name,
                                 CASE WHEN seq % 11 <> 1 THEN metric_value END AS metric_value) FROM eval_results)
    SELECT seq, 'source_name_without_url' AS rule FROM e WHERE source_name IS NOT NULL AND source_url IS NULL
    UNION ALL SELECT seq, 'missing_model_name' FROM e WHERE model_name IS NULL
    UNION ALL SELECT seq, 'missing_required_field' FROM e
      WHERE task_type IS NULL OR dataset_type IS NULL OR dataset_name IS NULL OR metric_type IS NULL
    UNION ALL SELECT seq, 'missing_metric_value' FROM e WHERE metric_value IS NULL""", "eval_results"))
def q_eval_violations(spark, sf):
    # results as a careless writer leaves them: fields missing here and there
    gap = lambda c, k: F.when(F.col("seq") % k != 1, F.col(c)).alias(c)
    e = X.eval_results(spark, sf).withColumns({c: gap(c, k) for c, k in (("model_name", 5), ("dataset_name", 7), ("metric_value", 11))})
    return CD.eval_violations(e)


# ----------------------------------------------------------- card text ---

def _cards(spark, sf):
    a = X.artifacts(spark, sf)
    n = X.nodes(spark, sf)
    langs = load(spark, sf, "documents").select(F.col("source").alias("node_name"), "lang")
    return CD.render_dataset_cards(CD.dataset_card_meta(a, n, langs))


def _duck_card_text() -> str:
    """DuckDB expression building the same card text from the same fields."""
    ph = f"'{S.MORE_INFO_NEEDED}'"
    lang = "array_to_string(language, ', ')"
    parts = ["'---'",
             "array_to_string(list_filter([CASE WHEN len(language) > 0 THEN 'language: [' || " + lang +
             " || ']' END, CASE WHEN size_categories IS NOT NULL THEN 'size_categories: ' || size_categories END,"
             " 'pretty_name: ' || pretty_name], lambda x: x IS NOT NULL), chr(10))",
             "'---'", "''", "'# Dataset Card for ' || pretty_name", "''"]
    bullets = {"Language(s) (NLP)": f"coalesce(nullif({lang}, ''), {ph})"}
    for heading, labels in CD.DATASET_CARD_SECTIONS:
        parts += [f"'{heading}'", "''"]
        if labels:
            parts += [f"'- **{lab}:** ' || " + bullets.get(lab, ph) for lab in labels] + ["''"]
        elif heading not in CD.HEADING_ONLY:
            parts += [ph, "''"]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_META_SQL = """meta AS (
    SELECT c.node_name AS card_id, c.node_name AS pretty_name, coalesce(l.language, []) AS language,
           CASE WHEN c.n_files < 1000 THEN 'n<1K' WHEN c.n_files < 10000 THEN '1K<n<10K'
                WHEN c.n_files < 100000 THEN '10K<n<100K' WHEN c.n_files < 1000000 THEN '100K<n<1M'
                ELSE 'n>1M' END AS size_categories
    FROM (SELECT n.node_name, count(*) AS n_files FROM artifacts a JOIN nodes n ON a.node_id = n.id GROUP BY 1) c
    LEFT JOIN (SELECT source AS node_name, list_sort(list_distinct(list(lang))) AS language
               FROM documents GROUP BY 1) l USING (node_name)),
 cards AS (SELECT card_id, """ + _duck_card_text() + """ AS text FROM meta)"""


@query("render_cards", W("WITH " + _META_SQL + " SELECT card_id, text FROM cards", "artifacts"))
def q_render_cards(spark, sf):
    return _cards(spark, sf)


_SPLIT_SQL = """sp AS (
    SELECT card_id, text,
           regexp_extract(text, '^(\\s*---[\\r\\n]+)([\\S\\s]*?)([\\r\\n]+---(\\r\\n|\\n|$))', 0) AS whole,
           regexp_extract(text, '^(\\s*---[\\r\\n]+)([\\S\\s]*?)([\\r\\n]+---(\\r\\n|\\n|$))', 2) AS header
    FROM cards),
 hl AS (
    SELECT card_id, CAST(pos - 1 AS BIGINT) AS pos, regexp_extract(line, '^([^:\\s#-][^:]*):\\s*(.*?)\\s*$', 1) AS key,
           regexp_extract(line, '^([^:\\s#-][^:]*):\\s*(.*?)\\s*$', 2) AS value,
           CASE WHEN regexp_matches(line, '^\\s*-\\s+') THEN regexp_extract(line, '^\\s*-\\s+(.*?)\\s*$', 1) END AS item
    FROM (SELECT card_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos
          FROM (SELECT card_id, string_split_regex(header, '\\r\\n|\\r|\\n') AS lines FROM sp))),
 hg AS (SELECT *, sum(CASE WHEN key <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY card_id ORDER BY pos) AS g FROM hl),
 ent AS (
    SELECT card_id, min(pos) FILTER (key <> '') AS pos, max(key) AS key, max(value) AS value,
           coalesce(string_agg(item, chr(10) ORDER BY pos) FILTER (key = ''), '') AS items
    FROM hg WHERE g > 0 GROUP BY card_id, g)"""
# the header's size category as a block list of two items
_BLOCK = r"regexp_replace(text, 'size_categories: (\S+)', 'size_categories:' || chr(10) || '- \1' || chr(10) || '- at a guess')"


def _listed_cards(spark, sf):
    return _cards(spark, sf).withColumn("text", F.regexp_replace(
        "text", r"size_categories: (\S+)", "size_categories:\n- $1\n- at a guess"))


def _flat_entries(entries):
    return entries.withColumn("items", F.array_join("items", "\n"))


@query("card_front_matter", W("WITH " + _META_SQL + ",\n listed AS (SELECT card_id, " + _BLOCK + " AS text FROM cards),\n "
                              + _SPLIT_SQL.replace("FROM cards)", "FROM listed)") + " SELECT * FROM ent", "artifacts"))
def q_card_front_matter(spark, sf):
    return _flat_entries(CD.header_entries(CD.split_front_matter(_listed_cards(spark, sf))))


@query("card_roundtrip", W("WITH " + _META_SQL + ",\n listed AS (SELECT card_id, " + _BLOCK + " AS text FROM cards),\n "
                           + _SPLIT_SQL.replace("FROM cards)", "FROM listed)") + """
    SELECT card_id, sha256(text) AS text_hash, length(whole) > 0 AS has_header, true AS roundtrip_equal FROM sp""",
                           "artifacts"))
def q_card_roundtrip(spark, sf):
    cards = CD.split_front_matter(_listed_cards(spark, sf))
    back = CD.reassemble(cards, CD.header_entries(cards))
    return (cards.join(back, "card_id")
            .select("card_id", F.sha2("text", 256).alias("text_hash"), "has_header",
                    (F.col("content") == F.col("text")).alias("roundtrip_equal")))


@query("dataset_card_metadata", W("WITH " + _META_SQL + """
    SELECT card_id, '{' || concat_ws(',', '"pretty_name":' || to_json(pretty_name), '"language":' || to_json(language),
           '"size_categories":' || to_json(size_categories)) || '}' AS metadata FROM meta""", "artifacts"))
def q_dataset_card_metadata(spark, sf):
    langs = load(spark, sf, "documents").select(F.col("source").alias("node_name"), "lang")
    return CD.dataset_card_metadata(CD.dataset_card_meta(X.artifacts(spark, sf), X.nodes(spark, sf), langs))


@query("unique_tags", """
    WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos
               FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
    f AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY ALL)
    SELECT doc_id, string_agg(word, ',' ORDER BY pos) AS tags FROM f GROUP BY doc_id""")
def q_unique_tags(spark, sf):
    d = load(spark, sf, "documents").select(
        "doc_id", F.split("text", " ").alias("tags"))
    return CD.unique_tags(d).select("doc_id", F.array_join("tags", ",").alias("tags"))


# ------------------------------------------------------ model registry ---

@query("model_registry_view", W("""
    WITH j AS (SELECT a.*, n.node_name FROM artifacts a JOIN nodes n ON a.node_id = n.id WHERE a.run_id IS NOT NULL),
    models AS (SELECT node_name, run_id, arg_min(location, id) AS location FROM j
               WHERE location NOT LIKE '%.md' GROUP BY ALL),
    cards AS (SELECT node_name, run_id, arg_min(location, id) AS card FROM j WHERE location LIKE '%.md' GROUP BY ALL),
    links AS (SELECT node_name, m.location, 'model_card_path' AS tag_name, c.card AS tag_value
              FROM models m JOIN cards c USING (node_name, run_id))
    SELECT m.node_name, m.run_id, m.location, l.tag_value AS card_location
    FROM models m LEFT JOIN links l ON l.node_name = m.node_name AND l.location = m.location""", "artifacts"))
def q_model_registry_view(spark, sf):
    # per (node, run) the model is the first non-markdown artifact and its
    # card the first markdown artifact, when the run produced one
    from ..operators import writes as K
    a = X.artifacts(spark, sf).where(F.col("run_id").isNotNull()).join(
        X.nodes(spark, sf).select(F.col("id").alias("node_id"), "node_name"), "node_id")
    is_md = F.col("location").endswith(".md")
    models = a.where(~is_md).groupBy("node_name", "run_id").agg(F.min_by("location", "id").alias("location"))
    cards = a.where(is_md).groupBy("node_name", "run_id").agg(F.min_by("location", "id").alias("card"))
    links = K.card_links(models.join(cards, ["node_name", "run_id"]).select(
        "node_name", F.col("location").alias("subject"), "card"), "model_path", "model_card_path")
    return CD.model_registry_view(models, links).select("node_name", "run_id", "location", "card_location")


# ------------------------------------------------------- dataset cards ---

@query("dataset_card_build", W("""
    SELECT n.node_name, count(*) AS n_files, CAST(sum(a.size) AS BIGINT) AS total_bytes,
           any_value(d.digest) AS distribution_digest
    FROM artifacts a JOIN nodes n ON a.node_id = n.id JOIN """ + FP.tree_digest_sql(
    "(SELECT n.node_name, a.location || '|' || a.hash AS line FROM artifacts a JOIN nodes n ON a.node_id = n.id)", "node_name")
    + " d USING (node_name) GROUP BY n.node_name", "artifacts"))
def q_dataset_card_build(spark, sf):
    return CD.dataset_card_summary(X.artifacts(spark, sf), X.nodes(spark, sf))


@query("card_distribution", W("""
    SELECT n.node_name AS dataset, 'cr:FileObject' AS type, a.location AS name, a.content_type AS encoding_format,
           a.location AS content_url, a.hash AS sha256, CAST(NULL AS VARCHAR) AS includes
    FROM artifacts a JOIN nodes n ON a.node_id = n.id""", "artifacts"))
def q_card_distribution(spark, sf):
    cards = CD.dataset_cards(X.artifacts(spark, sf), X.nodes(spark, sf), "2024-02-01")
    return CD.card_distribution(cards)


@query("card_record_fields", W("""
    SELECT node_name AS dataset, 'files' AS record_set, f.field, 'sc:Text' AS data_type
    FROM (SELECT DISTINCT n.node_name FROM artifacts a JOIN nodes n ON a.node_id = n.id),
         (SELECT 'filename' AS field UNION ALL SELECT 'content') f""", "artifacts"))
def q_card_record_fields(spark, sf):
    cards = CD.dataset_cards(X.artifacts(spark, sf), X.nodes(spark, sf), "2024-02-01")
    return CD.card_record_fields(cards)
