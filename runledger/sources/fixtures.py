"""Catalog tables derived from the driver's Parquet tables.

The run/artifact catalog has no public data set, so every catalog table here
is *derived* from a driver table with plain DataFrame code (FIXTURES.md §3).
Each builder only reshapes rows into the catalog schema; the operators that
consume them do the actual work and must be correct on any data of that
schema.

Every builder has a DuckDB twin in ``DUCKDB`` so the oracle SQL can rebuild
the same rows from the same Parquet views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .tables import load, memo_plan

# Fixed fixture parameters.
RUN_EPOCH = "2024-01-01"          # day 0 of the derived run numbering
METADATA_STORE = "metadata_store"
LEAF_STORE = "leaf_store"
RESOURCE_NODE_TYPE = "FilesystemStoreNode"
ACTION_NODE_TYPE = "BaseActionNode"
STORE_NODE_TYPE = "SQLiteMetadataStoreNode"

# event_type -> node status of the derived status stream
STATUS_OF_EVENT = {"view": "QUEUED", "click": "PREPARATION", "signup": "EXECUTING",
                   "purchase": "COMPLETE", "error": "ERROR"}
# conversation role -> lifecycle mark
MARK_OF_ROLE = {"system": "new", "user": "using", "assistant": "used"}
STATE_BY_BUCKET = ["new", "using", "used", "produced", "unused"]


def _run_day(ts_col):
    return F.datediff(F.to_date(ts_col), F.lit(RUN_EPOCH).cast("date")).cast("long")


def _map_expr(col, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, v) if expr is None else expr.when(col == k, v))
    return expr


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------

@memo_plan
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    ev = load(spark, sf_dir, "events")
    res = (docs.select(F.col("source").alias("node_name")).distinct()
           .select("node_name", F.lit(RESOURCE_NODE_TYPE).alias("node_type"),
                   F.lit(S.BASE_RESOURCE).alias("base_type")))
    act = (ev.select(F.concat(F.lit("job_"), "event_type").alias("node_name")).distinct()
           .select("node_name", F.lit(ACTION_NODE_TYPE).alias("node_type"),
                   F.lit(S.BASE_ACTION).alias("base_type")))
    # the one metadata-store node is a fixed row
    store = spark.createDataFrame([(METADATA_STORE, STORE_NODE_TYPE, S.BASE_METADATA)],
                                  "node_name string, node_type string, base_type string")
    allnodes = res.unionByName(act).unionByName(store)
    # the node list is bounded by the number of distinct sources + job types,
    # so a single ordered window for dense ids is cheap here.
    return allnodes.select(
        F.row_number().over(Window.orderBy("node_name")).cast("long").alias("id"),
        "node_name", "node_type", "base_type")


@memo_plan
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of signups; the newest run is still open (end_time NULL)."""
    ev = load(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    per_day = ev.groupBy(_run_day("ts").alias("run_id")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    # one row per run: the global window is over the (small) run list only
    last = F.max("run_id").over(Window.partitionBy())
    return per_day.select(
        "run_id", "start_time",
        F.when(F.col("run_id") == last, F.lit(None)).otherwise(F.col("end_time"))
         .cast("timestamp_ntz").alias("end_time"),
        F.lit(None).cast("string").alias("hash"))


@memo_plan
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    n = nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "node_name")
    bucket = F.floor(F.col("doc_id") / 20).cast("long") % 5
    state = F.element_at(F.array(*[F.lit(s) for s in STATE_BY_BUCKET]), (bucket + 1).cast("int"))
    ext = (F.when(F.col("doc_id") % 4 == 0, ".json")
           .when(F.col("doc_id") % 4 == 1, ".md").otherwise(".txt"))
    return (d.join(n, d.source == n.node_name, "inner")
            .select(F.col("doc_id").alias("id"),
                    F.when(bucket == 0, F.lit(None)).otherwise(F.col("doc_id") % 30)
                     .cast("long").alias("run_id"),
                    "node_id",
                    F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("location"),
                    F.lit(None).cast("timestamp_ntz").alias("created_at"),
                    state.alias("state"),
                    F.sha2("text", 256).alias("hash"),
                    F.lit(S.HASH_ALGORITHM).alias("hash_algorithm"),
                    F.col("n_chars").alias("size"),
                    F.lit("text/plain").alias("content_type")))


@memo_plan
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    n = nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "node_name")
    return (ev.join(n, F.concat(F.lit("job_"), ev.event_type) == n.node_name, "inner")
            .select(F.col("event_id").alias("id"), _run_day("ts").alias("run_id"), "node_id",
                    F.col("event_type").alias("metric_name"),
                    F.col("value").alias("metric_value"), F.col("ts").alias("logged_at")))


@memo_plan
def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    n = nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "node_name")
    kv = ev.select("event_id", "ts", "event_type",
                   F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return (kv.join(n, F.concat(F.lit("job_"), kv.event_type) == n.node_name, "inner")
            .select(F.col("event_id").alias("id"), _run_day("ts").alias("run_id"), "node_id",
                    F.col("k").alias("param_name"), F.col("v").alias("param_value")))


@memo_plan
def art_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = load(spark, sf_dir, "labels")
    return (lb.select("doc_id", F.col("quality").cast("string").alias("quality"),
                      F.col("toxic").cast("string").alias("toxic"))
            .unpivot("doc_id", ["quality", "toxic"], "tag_name", "tag_value")
            .select(F.col("doc_id").alias("artifact_id"), "tag_name", "tag_value"))


@memo_plan
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag rows (id, tag_name, tag_value) behind the artifact link table."""
    t = art_tags(spark, sf_dir)
    return t.select((F.col("artifact_id") * 2 + F.when(F.col("tag_name") == "quality", 0).otherwise(1))
                    .alias("id"), F.lit(None).cast("long").alias("run_id"),
                    F.lit(None).cast("long").alias("node_id"), "tag_name", "tag_value")


@memo_plan
def artifact_tag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = art_tags(spark, sf_dir)
    return t.select("artifact_id", (F.col("artifact_id") * 2 + F.when(
        F.col("tag_name") == "quality", 0).otherwise(1)).alias("tag_id"))


@memo_plan
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending triggers (run_triggered NULL) logged by resource nodes."""
    ev = load(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") > 40))
    n = nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "node_name")
    t = ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("node_name"),
        F.col("ts").alias("trigger_time"),
        F.concat(F.lit("value = "), F.col("value").cast("decimal(18,2)").cast("string")).alias("message"))
    return t.join(n, "node_name").select(
        "id", F.lit(None).cast("long").alias("run_triggered"), "node_id", "trigger_time", "message")


@memo_plan
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = load(spark, sf_dir, "conversations")
    state = _map_expr(F.col("role"), MARK_OF_ROLE)
    return cv.select(F.col("conv_id").alias("artifact_id"), F.col("turn").alias("seq"),
                     state.alias("state"),
                     F.when(F.col("role") == "user", F.col("turn")).cast("long").alias("run_id"))


@memo_plan
def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"),
                     F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("node_name"),
                     _map_expr(F.col("event_type"), STATUS_OF_EVENT).alias("status"),
                     F.col("ts"))


@memo_plan
def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat evaluation results: one per (flag, status, year, quarter, metric)."""
    li = load(spark, sf_dir, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("yr"),
                   F.quarter("l_shipdate").alias("qtr")).agg(
        F.count(F.lit(1)).cast("double").alias("count"), F.max("l_quantity").alias("max_qty"))
    long = g.unpivot(["l_returnflag", "l_linestatus", "yr", "qtr"], ["count", "max_qty"],
                     "metric_type", "metric_value")
    # bounded: flags x statuses x years x quarters x 2 rows
    w = Window.orderBy("l_returnflag", "l_linestatus", "yr", "qtr", "metric_type")
    return long.select(
        F.row_number().over(w).cast("long").alias("seq"),
        F.concat(F.lit("model-"), "l_returnflag").alias("model_name"),
        F.concat(F.lit("ship-"), "l_linestatus").alias("task_type"),
        F.when(F.col("l_linestatus") == "O", "Shipping").alias("task_name"),
        F.lit("lineitem").alias("dataset_type"),
        F.lit("Line items").alias("dataset_name"),
        F.col("yr").cast("string").alias("dataset_config"),
        F.lit("test").alias("dataset_split"),
        F.lit(None).cast("string").alias("dataset_revision"),
        F.when(F.col("yr") % 2 == 0, F.concat(F.lit('{"year":'), F.col("yr").cast("string"), F.lit("}"))).alias("dataset_args"),
        "metric_type", "metric_value",
        F.when(F.col("metric_type") == "count", "Count").alias("metric_name"),
        F.lit(None).cast("string").alias("metric_config"),
        F.when(F.col("qtr") <= 2, '{"agg":"plain","half":1}').alias("metric_args"),
        (F.col("yr") > 1994).alias("verified"),
        F.concat(F.lit("q"), F.col("qtr").cast("string")).alias("verify_token"),
        F.when(F.col("l_linestatus") == "F", F.lit("ledger")).alias("source_name"),
        F.when(F.col("l_returnflag") == "R",
               F.concat(F.lit("https://ledger.example.org/"), "l_returnflag")).alias("source_url"))


@memo_plan
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered pipeline nodes of a local graph and a leaf graph.

    local: metadata_store -> region (resource) -> nation (action) -> customer (action);
    only customers with at least one order are registered.
    leaf: leaf_store -> supplier -> nation; a supplier with a negative balance
    is registered as an action (a misconfigured node)."""
    reg = load(spark, sf_dir, "region")
    nat = load(spark, sf_dir, "nation")
    cus = load(spark, sf_dir, "customer")
    odr = load(spark, sf_dir, "orders")
    sup = load(spark, sf_dir, "supplier")
    stores = spark.createDataFrame([(METADATA_STORE, S.BASE_METADATA, "local"),
                                    (LEAF_STORE, S.BASE_METADATA, "leaf")],
                                   "node_name string, base_type string, graph string")
    regions = reg.select(F.concat(F.lit("region:"), "r_name").alias("node_name"),
                         F.lit(S.BASE_RESOURCE).alias("base_type"), F.lit("local").alias("graph"))
    nations = nat.select(F.concat(F.lit("nation:"), "n_name").alias("node_name"),
                         F.lit(S.BASE_ACTION).alias("base_type"), F.lit("local").alias("graph"))
    customers = (cus.join(odr, cus.c_custkey == odr.o_custkey, "left_semi")
                 .select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_name"),
                         F.lit(S.BASE_ACTION).alias("base_type"), F.lit("local").alias("graph")))
    suppliers = sup.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_name"),
                           F.when(F.col("s_acctbal") < 0, F.lit(S.BASE_ACTION))
                            .otherwise(F.lit(S.BASE_RESOURCE)).alias("base_type"),
                           F.lit("leaf").alias("graph"))
    return stores.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers)


@memo_plan
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = load(spark, sf_dir, "region")
    nat = load(spark, sf_dir, "nation")
    cus = load(spark, sf_dir, "customer")
    sup = load(spark, sf_dir, "supplier")
    e1 = reg.select(F.lit(METADATA_STORE).alias("src"),
                    F.concat(F.lit("region:"), "r_name").alias("dst"), F.lit("local").alias("graph"))
    e2 = (nat.join(reg, nat.n_regionkey == reg.r_regionkey)
          .select(F.concat(F.lit("region:"), "r_name").alias("src"),
                  F.concat(F.lit("nation:"), "n_name").alias("dst"), F.lit("local").alias("graph")))
    e3 = (cus.join(nat, cus.c_nationkey == nat.n_nationkey)
          .select(F.concat(F.lit("nation:"), "n_name").alias("src"),
                  F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("dst"),
                  F.lit("local").alias("graph")))
    e4 = sup.select(F.lit(LEAF_STORE).alias("src"),
                    F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("dst"),
                    F.lit("leaf").alias("graph"))
    e5 = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
          .select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"),
                  F.concat(F.lit("nation:"), "n_name").alias("dst"), F.lit("leaf").alias("graph")))
    return e1.unionByName(e2).unionByName(e3).unionByName(e4).unionByName(e5)


@memo_plan
def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation -> nation flow graph (customer nation buys from supplier nation);
    dense and cyclic, used by the cycle check."""
    li = load(spark, sf_dir, "lineitem")
    od = load(spark, sf_dir, "orders")
    cu = load(spark, sf_dir, "customer")
    su = load(spark, sf_dir, "supplier")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
         .join(cu, od.o_custkey == cu.c_custkey)
         .join(su, li.l_suppkey == su.s_suppkey))
    return (j.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"),
                     F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
            .where(F.col("src") != F.col("dst")).distinct())


@memo_plan
def doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemaless document store: one record per event, ``type`` + VARIANT payload."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"),
                     F.parse_json("props").alias("payload"))


@memo_plan
def snap_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return (d.where(F.col("doc_id") % 10 != 0)
            .select(F.col("doc_id").alias("id"),
                    F.when(F.col("doc_id") % 7 == 0, "new").otherwise("used").alias("state")))


@memo_plan
def snap_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.lit("used").alias("state"))


# ---------------------------------------------------------------------------
# DuckDB twins (bodies of CTEs); ``with_fixtures`` assembles them.
# ---------------------------------------------------------------------------

_ST = STATUS_OF_EVENT
_MK = MARK_OF_ROLE

DUCKDB: dict[str, tuple[list[str], str]] = {
    "nodes": ([], f"""
        SELECT CAST(row_number() OVER (ORDER BY node_name) AS BIGINT) AS id, node_name, node_type, base_type
        FROM (SELECT DISTINCT source AS node_name, '{RESOURCE_NODE_TYPE}' AS node_type,
                     '{S.BASE_RESOURCE}' AS base_type FROM documents
              UNION ALL
              SELECT DISTINCT 'job_' || event_type, '{ACTION_NODE_TYPE}', '{S.BASE_ACTION}' FROM events
              UNION ALL
              SELECT '{METADATA_STORE}', '{STORE_NODE_TYPE}', '{S.BASE_METADATA}') u"""),
    "runs": ([], f"""
        SELECT run_id, start_time,
               CASE WHEN run_id = max(run_id) OVER () THEN NULL ELSE end_time END AS end_time,
               CAST(NULL AS VARCHAR) AS hash
        FROM (SELECT CAST(date_diff('day', DATE '{RUN_EPOCH}', CAST(ts AS DATE)) AS BIGINT) AS run_id,
                     min(ts) AS start_time, max(ts) AS end_time
              FROM events WHERE event_type = 'signup' GROUP BY 1) r"""),
    "artifacts": (["nodes"], """
        SELECT d.doc_id AS id,
               CASE WHEN CAST(floor(d.doc_id / 20) AS BIGINT) % 5 = 0 THEN NULL
                    ELSE d.doc_id % 30 END AS run_id,
               n.id AS node_id,
               d.lang || '/' || CAST(d.doc_id AS VARCHAR) ||
                 CASE d.doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.md' ELSE '.txt' END AS location,
               CAST(NULL AS TIMESTAMP) AS created_at,
               CASE CAST(floor(d.doc_id / 20) AS BIGINT) % 5
                    WHEN 0 THEN 'new' WHEN 1 THEN 'using' WHEN 2 THEN 'used'
                    WHEN 3 THEN 'produced' ELSE 'unused' END AS state,
               sha256(d.text) AS hash, 'sha256' AS hash_algorithm,
               d.n_chars AS size, 'text/plain' AS content_type
        FROM documents d JOIN nodes n ON n.node_name = d.source"""),
    "metrics": (["nodes"], f"""
        SELECT e.event_id AS id,
               CAST(date_diff('day', DATE '{RUN_EPOCH}', CAST(e.ts AS DATE)) AS BIGINT) AS run_id,
               n.id AS node_id, e.event_type AS metric_name, e.value AS metric_value, e.ts AS logged_at
        FROM events e JOIN nodes n ON n.node_name = 'job_' || e.event_type"""),
    "params": (["nodes"], f"""
        SELECT p.event_id AS id,
               CAST(date_diff('day', DATE '{RUN_EPOCH}', CAST(p.ts AS DATE)) AS BIGINT) AS run_id,
               n.id AS node_id, p.k AS param_name, json_extract_string(p.props, '$.' || p.k) AS param_value
        FROM (SELECT event_id, ts, event_type, props, unnest(json_keys(CAST(props AS JSON))) AS k
              FROM events) p
        JOIN nodes n ON n.node_name = 'job_' || p.event_type"""),
    "art_tags": ([], """
        SELECT doc_id AS artifact_id, tag_name, tag_value
        FROM (SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels)
        UNPIVOT INCLUDE NULLS (tag_value FOR tag_name IN (quality, toxic))"""),
    "tags": (["art_tags"], """
        SELECT artifact_id * 2 + CASE WHEN tag_name = 'quality' THEN 0 ELSE 1 END AS id,
               CAST(NULL AS BIGINT) AS run_id, CAST(NULL AS BIGINT) AS node_id, tag_name, tag_value
        FROM art_tags"""),
    "artifact_tag_links": (["art_tags"], """
        SELECT artifact_id, artifact_id * 2 + CASE WHEN tag_name = 'quality' THEN 0 ELSE 1 END AS tag_id
        FROM art_tags"""),
    "triggers": (["nodes"], """
        SELECT e.event_id AS id, CAST(NULL AS BIGINT) AS run_triggered, n.id AS node_id,
               e.ts AS trigger_time,
               'value = ' || CAST(CAST(e.value AS DECIMAL(18,2)) AS VARCHAR) AS message
        FROM events e JOIN nodes n ON n.node_name = 'src' || CAST(e.user_id % 20 AS VARCHAR)
        WHERE e.event_type = 'error' AND e.value > 40"""),
    "marks": ([], f"""
        SELECT conv_id AS artifact_id, turn AS seq,
               CASE role {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MK.items())} END AS state,
               CASE WHEN role = 'user' THEN turn END AS run_id
        FROM conversations"""),
    "status_events": ([], f"""
        SELECT event_id AS id, 'src' || CAST(user_id % 20 AS VARCHAR) AS node_name,
               CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ST.items())} END AS status,
               ts
        FROM events"""),
    "eval_results": ([], """
        SELECT CAST(row_number() OVER (ORDER BY l_returnflag, l_linestatus, yr, qtr, metric_type) AS BIGINT) AS seq,
               'model-' || l_returnflag AS model_name, 'ship-' || l_linestatus AS task_type,
               CASE WHEN l_linestatus = 'O' THEN 'Shipping' END AS task_name, 'lineitem' AS dataset_type, 'Line items' AS dataset_name,
               CAST(yr AS VARCHAR) AS dataset_config, 'test' AS dataset_split,
               CAST(NULL AS VARCHAR) AS dataset_revision,
               CASE WHEN yr % 2 = 0 THEN '{"year":' || CAST(yr AS VARCHAR) || '}' END AS dataset_args, metric_type, metric_value,
               CASE WHEN metric_type = 'count' THEN 'Count' END AS metric_name, CAST(NULL AS VARCHAR) AS metric_config,
               CASE WHEN qtr <= 2 THEN '{"agg":"plain","half":1}' END AS metric_args, yr > 1994 AS verified, 'q' || CAST(qtr AS VARCHAR) AS verify_token,
               CASE WHEN l_linestatus = 'F' THEN 'ledger' END AS source_name,
               CASE WHEN l_returnflag = 'R' THEN 'https://ledger.example.org/' || l_returnflag END AS source_url
        FROM (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS yr, quarter(l_shipdate) AS qtr,
                     CAST(count(*) AS DOUBLE) AS "count", max(l_quantity) AS max_qty
              FROM lineitem GROUP BY ALL)
        UNPIVOT (metric_value FOR metric_type IN ("count", max_qty))"""),
    "graph_nodes": ([], f"""
        SELECT '{METADATA_STORE}' AS node_name, '{S.BASE_METADATA}' AS base_type, 'local' AS graph
        UNION ALL SELECT '{LEAF_STORE}', '{S.BASE_METADATA}', 'leaf'
        UNION ALL SELECT 'region:' || r_name, '{S.BASE_RESOURCE}', 'local' FROM region
        UNION ALL SELECT 'nation:' || n_name, '{S.BASE_ACTION}', 'local' FROM nation
        UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), '{S.BASE_ACTION}', 'local' FROM customer
                  WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
        UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR),
                  CASE WHEN s_acctbal < 0 THEN '{S.BASE_ACTION}' ELSE '{S.BASE_RESOURCE}' END, 'leaf'
                  FROM supplier"""),
    "graph_edges": ([], f"""
        SELECT '{METADATA_STORE}' AS src, 'region:' || r_name AS dst, 'local' AS graph FROM region
        UNION ALL SELECT 'region:' || r_name, 'nation:' || n_name, 'local'
                  FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'nation:' || n_name, 'customer:' || CAST(c_custkey AS VARCHAR), 'local'
                  FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT '{LEAF_STORE}', 'supplier:' || CAST(s_suppkey AS VARCHAR), 'leaf' FROM supplier
        UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'nation:' || n_name, 'leaf'
                  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "trade_edges": ([], """
        SELECT DISTINCT 'n' || CAST(c.c_nationkey AS VARCHAR) AS src, 'n' || CAST(s.s_nationkey AS VARCHAR) AS dst
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
        WHERE c.c_nationkey <> s.s_nationkey"""),
    "snap_old": ([], """
        SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'used' END AS state
        FROM documents WHERE doc_id % 10 <> 0"""),
    "snap_new": ([], "SELECT doc_id AS id, 'used' AS state FROM documents"),
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named fixtures (and their deps)."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for dep in DUCKDB[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({DUCKDB[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
