"""Pipeline-graph queries (G-1..G-7, U-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import fixtures as X
from .registry import query

W = X.with_fixtures

_SOURCES_SQL = """nodes_all AS (SELECT src AS node_name FROM graph_edges UNION SELECT dst FROM graph_edges
                   UNION SELECT node_name FROM graph_nodes)"""


@query("dag_edges", W("SELECT DISTINCT src, dst FROM graph_edges", "graph_edges"))
def q_dag_edges(spark, sf):
    # node descriptors (name, predecessors[]) are built from the edge table,
    # then exploded back into edges
    e = X.graph_edges(spark, sf)
    desc = (G.neighbour_lists(e).where(F.col("direction") == "in")
            .select(F.col("node_name").alias("name"), F.col("neighbours").alias("predecessors")))
    return G.edges_from_predecessors(desc).distinct()


@query("dag_neighbours", W("""
    SELECT node_name, direction, part, CAST(sum(count(*)) OVER (PARTITION BY node_name, direction) AS BIGINT) AS degree,
           string_agg(nb, ',' ORDER BY nb) AS neighbours
    FROM (SELECT *, left(md5(nb), 2) AS part FROM (SELECT dst AS node_name, 'in' AS direction, src AS nb FROM graph_edges
          UNION ALL SELECT src, 'out', dst FROM graph_edges))
    GROUP BY node_name, direction, part""", "graph_edges"))
def q_dag_neighbours(spark, sf):
    return G.neighbour_lists(X.graph_edges(spark, sf)).withColumn(
        "neighbours", F.array_join("neighbours", ","))


@query("dag_levels", W(f"""
    WITH RECURSIVE {_SOURCES_SQL},
    src0 AS (SELECT node_name FROM nodes_all WHERE node_name NOT IN (SELECT dst FROM graph_edges)),
    e AS (SELECT DISTINCT src, dst FROM graph_edges),
    p(node_name, depth) AS (SELECT node_name, 0 FROM src0
                            UNION ALL SELECT e.dst, p.depth + 1 FROM p JOIN e ON e.src = p.node_name)
    SELECT node_name, CAST(max(depth) AS BIGINT) AS level FROM p GROUP BY node_name""",
                       "graph_edges", "graph_nodes"))
def q_dag_levels(spark, sf):
    levels, _ = G.peel(X.graph_nodes(spark, sf), X.graph_edges(spark, sf))
    return levels


@query("dag_cycles", W("""
    WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM trade_edges
                               UNION SELECT r.a, e.dst FROM r JOIN trade_edges e ON e.src = r.b),
    cyc AS (SELECT DISTINCT a AS node FROM r WHERE a = b),
    nodes_all AS (SELECT src AS n FROM trade_edges UNION SELECT dst FROM trade_edges)
    SELECT n AS node_name FROM nodes_all
    WHERE EXISTS (SELECT 1 FROM r JOIN cyc ON r.a = cyc.node WHERE r.b = nodes_all.n)
      AND EXISTS (SELECT 1 FROM r JOIN cyc ON r.b = cyc.node WHERE r.a = nodes_all.n)""", "trade_edges"))
def q_dag_cycles(spark, sf):
    return G.cyclic_core(None, X.trade_edges(spark, sf))


@query("dag_violations", W("""
    WITH t AS (SELECT node_name, base_type FROM graph_nodes),
    j AS (SELECT e.src, e.dst, s.base_type AS src_type, d.base_type AS dst_type
          FROM graph_edges e LEFT JOIN t s ON s.node_name = e.src LEFT JOIN t d ON d.node_name = e.dst)
    SELECT CASE WHEN dst_type IS NULL THEN 'unregistered_successor'
                WHEN src_type = 'BaseMetadataStoreNode' AND dst_type <> 'BaseResourceNode'
                  THEN 'store_successor_not_resource'
                WHEN src_type = 'BaseResourceNode' AND dst_type <> 'BaseActionNode'
                  THEN 'resource_successor_not_action' END AS rule, src, dst
    FROM j WHERE rule IS NOT NULL
    UNION ALL
    SELECT 'multiple_metadata_stores', node_name, NULL FROM t
    WHERE base_type = 'BaseMetadataStoreNode'
      AND (SELECT count(*) FROM t WHERE base_type = 'BaseMetadataStoreNode') > 1""",
                           "graph_edges", "graph_nodes"))
def q_dag_violations(spark, sf):
    return G.violations(X.graph_nodes(spark, sf), X.graph_edges(spark, sf))


@query("lineage", W("""
    WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM graph_edges),
    r(seed, node, depth) AS (
        SELECT node_name, node_name, 0 FROM graph_nodes WHERE base_type = 'BaseMetadataStoreNode'
        UNION ALL SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
    SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY ALL""",
                    "graph_edges", "graph_nodes"))
def q_lineage(spark, sf):
    seeds = X.graph_nodes(spark, sf).where(F.col("base_type") == "BaseMetadataStoreNode").select("node_name")
    return G.downstream(X.graph_edges(spark, sf), seeds)


@query("merged_graph", W("""
    WITH m AS (
      SELECT n.node_name, g.base_type, n.graph FROM (
        SELECT src AS node_name, graph FROM graph_edges UNION SELECT dst, graph FROM graph_edges
        UNION SELECT node_name, graph FROM graph_nodes) n
      LEFT JOIN graph_nodes g ON g.node_name = n.node_name AND g.graph = n.graph)
    SELECT node_name, min(base_type) AS base_type, count(DISTINCT graph) AS n_graphs FROM m GROUP BY node_name""",
                         "graph_edges", "graph_nodes"))
def q_merged_graph(spark, sf):
    n = X.graph_nodes(spark, sf)
    e = X.graph_edges(spark, sf)
    graphs = [(g, n.where(F.col("graph") == g), e.where(F.col("graph") == g)) for g in ("local", "leaf")]
    return G.merge_graphs(graphs)
