"""Catalog reads: projections, filters, fact -> node joins, counts.

All functions take catalog DataFrames and return DataFrames; nothing is
collected.  Fact tables (artifacts, metrics, params, tags, triggers) grow with
the data; ``nodes`` is the pipeline's node list and stays small, so every
fact -> node join is an equi-join that AQE turns into a broadcast hash join
once it has measured the node side (``spark.sql.adaptive.autoBroadcastJoinThreshold``);
above that size it stays a shuffle join.  No explicit broadcast hint is used
because the node list has no hard bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .ordered import top_k_per_group

ENTRY_COLUMNS = ["id", "run_id", "location", "created_at", "state", "hash",
                 "hash_algorithm", "size", "content_type", "node_name"]


def _node_names(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node_id"), "node_name")


def check_state(state: str) -> str:
    """N-16 scalar form: the five artifact states, or "all"."""
    if state != S.STATE_ALL and state not in S.ARTIFACT_STATES:
        raise ValueError(f"invalid state {state!r}; expected one of {S.ARTIFACT_STATES} or 'all'")
    return state


# P-1 -----------------------------------------------------------------------
def runs_view(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "start_time", "end_time", "hash")


# P-2 -----------------------------------------------------------------------
def nodes_info(nodes: DataFrame, node_id: int | None = None, node_name: str | None = None,
               both: str = "id_wins") -> DataFrame:
    """Nodes by id or name.  With both given the SQL store lets the id win
    (``both="id_wins"``); the document store requires both (``both="and"``)."""
    out = nodes
    if node_id is not None:
        out = out.where(F.col("id") == F.lit(node_id))
        if both == "id_wins":
            return out
    if node_name is not None:
        out = out.where(F.col("node_name") == F.lit(node_name))
    return out


# P-3 -----------------------------------------------------------------------
def node_ids(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Resolve a frame of ``node_name`` requests to ids.

    The reference raises on the first unknown name; in bulk every request
    gets a row, unknown names carry ``id`` NULL and ``found`` false.  When a
    name occurs twice in ``nodes`` the lowest id wins (``first()``)."""
    first_id = nodes.groupBy("node_name").agg(F.min("id").alias("id"))
    return (names.select("node_name").distinct()
            .join(first_id, "node_name", "left")
            .select("node_name", "id", F.col("id").isNotNull().alias("found")))


# P-4 -----------------------------------------------------------------------
def entries_exist(artifacts: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each (node_name, location) request: does the catalog hold it?

    The catalog is first cut down to the requested keys (semi join), so only
    matching rows are de-duplicated; requests are never fanned out."""
    req = requests.select("node_name", "location").distinct()
    hits = (artifacts.join(_node_names(nodes), "node_id").select("node_name", "location")
            .join(req, ["node_name", "location"], "left_semi").distinct()
            .withColumn("_hit", F.lit(True)))
    return (req.join(hits, ["node_name", "location"], "left")
            .select("node_name", "location", F.coalesce("_hit", F.lit(False)).alias("exists")))


# P-5 + J-1 -------------------------------------------------------------------
def entries(artifacts: DataFrame, nodes: DataFrame, node_name: str | None = None,
            state: str = S.STATE_ALL, run_id: int | None = None) -> DataFrame:
    check_state(state)
    if run_id is not None and run_id < 0:
        raise ValueError(f"no run can have the id {run_id}")
    a = artifacts
    if state != S.STATE_ALL:
        a = a.where(F.col("state") == F.lit(state))
    if run_id is not None:
        a = a.where(F.col("run_id") == F.lit(run_id))
    n = _node_names(nodes)
    if node_name is not None:
        n = n.where(F.col("node_name") == F.lit(node_name))
    cols = [c for c in ENTRY_COLUMNS if c in a.columns or c == "node_name"]
    return a.join(n, "node_id", "inner").select(*cols)


# P-6 -----------------------------------------------------------------------
def list_artifacts(artifacts: DataFrame, nodes: DataFrame, node_name: str | None = None,
                   state: str = S.STATE_ALL) -> DataFrame:
    return entries(artifacts, nodes, node_name=node_name, state=state).select("node_name", "location")


# P-7 -----------------------------------------------------------------------
def artifact_by_id(artifacts: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk point lookup: every requested id, with ``found`` false when absent."""
    e = entries(artifacts, nodes)
    return (ids.select(F.col("id")).distinct()
            .join(e, "id", "left")
            .withColumn("found", F.col("location").isNotNull()))


# P-8 -----------------------------------------------------------------------
def artifact_hash(artifacts: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored hash per (node_name, location); ties go to the lowest id.

    Only catalog rows whose key was requested are aggregated (semi join
    first)."""
    req = requests.select("node_name", "location").distinct()
    e = (artifacts.join(_node_names(nodes), "node_id").select("node_name", "location", "id", "hash")
         .join(req, ["node_name", "location"], "left_semi"))
    best = e.groupBy("node_name", "location").agg(
        F.min_by("hash", "id").alias("hash"), F.min("id").alias("id"))
    return (req.join(best, ["node_name", "location"], "left")
            .select("node_name", "location", "id", "hash"))


# P-9 -----------------------------------------------------------------------
def artifacts_by_suffix(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The three suffix views: cards (.json), models (not .md), text models (.txt)."""
    e = entries(artifacts, nodes)
    loc = F.col("location")
    return e.select("id", "node_name", "location",
                    loc.endswith(".json").alias("is_card"),
                    (~loc.endswith(".md")).alias("is_model"),
                    loc.endswith(".txt").alias("is_text_model"))


# J-1 for the other fact tables -----------------------------------------------
def metrics_view(metrics: DataFrame, nodes: DataFrame, node_name: str | None = None,
                 run_id: int | None = None) -> DataFrame:
    m = metrics if run_id is None else metrics.where(F.col("run_id") == F.lit(run_id))
    n = _node_names(nodes)
    if node_name is not None:
        n = n.where(F.col("node_name") == F.lit(node_name))
    return m.join(n, "node_id").select("id", "run_id", "metric_name", "metric_value", "node_name")


def params_view(params: DataFrame, nodes: DataFrame, node_name: str | None = None,
                run_id: int | None = None) -> DataFrame:
    p = params if run_id is None else params.where(F.col("run_id") == F.lit(run_id))
    n = _node_names(nodes)
    if node_name is not None:
        n = n.where(F.col("node_name") == F.lit(node_name))
    return p.join(n, "node_id").select("id", "run_id", "param_name", "param_value", "node_name")


def tags_view(tags: DataFrame, nodes: DataFrame, node_name: str | None = None,
              run_id: int | None = None) -> DataFrame:
    t = tags if run_id is None else tags.where(F.col("run_id") == F.lit(run_id))
    n = _node_names(nodes)
    if node_name is not None:
        n = n.where(F.col("node_name") == F.lit(node_name))
    return t.join(n, "node_id").select("id", "run_id", "tag_name", "tag_value", "node_name")


def triggers_view(triggers: DataFrame, nodes: DataFrame, node_name: str | None = None) -> DataFrame:
    n = _node_names(nodes)
    if node_name is not None:
        n = n.where(F.col("node_name") == F.lit(node_name))
    return triggers.join(n, "node_id").select("id", "run_triggered", "trigger_time", "message", "node_name")


# J-2 + N-18 -------------------------------------------------------------------
def artifact_tags(artifacts: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Artifact <-> tag through the link table; ``tag`` is the one-entry map
    ``{tag_name: tag_value}`` the reference returns per tag."""
    return (artifacts.select(F.col("id").alias("artifact_id"), "location")
            .join(links, "artifact_id")
            .join(tags.select(F.col("id").alias("tag_id"), "tag_name", "tag_value"), "tag_id")
            .select("artifact_id", "location", "tag_id", "tag_name", "tag_value",
                    F.create_map("tag_name", "tag_value").alias("tag")))


# A-1 -----------------------------------------------------------------------
def num_entries(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Artifact counts per node and state, plus the ``all`` row per node.

    One aggregation with GROUPING SETS ((node, state), (node)): partial
    aggregation runs map-side, so a hot node costs no more than a cold one."""
    g = (artifacts.rollup("node_id", "state")
         .agg(F.count(F.lit(1)).alias("num_entries"), F.grouping_id().alias("_gid"))
         .where(F.col("_gid") < 3))                      # drop the grand total
    return (g.join(_node_names(nodes), "node_id")
            .select("node_name",
                    F.when(F.col("_gid") == 1, F.lit(S.STATE_ALL)).otherwise(F.col("state")).alias("state"),
                    "num_entries"))


# O-1 -----------------------------------------------------------------------
def recent_artifacts(artifacts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Newest ``k`` artifacts per node (the GUI shows lists newest first).

    ``k`` is the feature (a top-k report).  Ranked in two salted phases
    (``ordered.top_k_per_group``), so a hot node is spread over many tasks
    and only ``salts * k`` candidates per node reach the final ranking."""
    ranked = top_k_per_group(artifacts.select("id", "node_id", "location", "state"), ["node_id"],
                             [F.col("id").desc()], k, salt_col="id")
    return (ranked.join(_node_names(nodes), "node_id")
            .select("node_name", "id", "location", "state", "rank"))
