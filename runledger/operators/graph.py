"""Pipeline graphs held as tables: ``nodes(node_name, base_type)`` and
``edges(src, dst)``.

Recursive questions (acyclicity, topological level, downstream closure) are
driver loops of joins: each round is one distributed join/anti-join over the
edge table, and the loop runs once per graph level, not per node.  Lineage is
cut with reliable ``checkpoint()`` into the shared checkpoint folder every few
rounds, so a lost executor never forces a replay from round 0.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ensure_checkpoint_dir

CHECKPOINT_EVERY = 3
PART_DIGITS = 2


def _cut(df: DataFrame, rnd: int) -> DataFrame:
    if rnd % CHECKPOINT_EVERY == 0:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df


def all_nodes(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_name")).unionByName(edges.select(F.col("dst").alias("node_name")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("node_name"))
    return ends.distinct()


# G-1 -----------------------------------------------------------------------
def edges_from_predecessors(descriptors: DataFrame) -> DataFrame:
    """Node descriptors ``(name, predecessors[])`` -> edges ``(src, dst)``."""
    return descriptors.select(F.explode("predecessors").alias("src"), F.col("name").alias("dst"))


# G-6 -----------------------------------------------------------------------
def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Predecessors and successors of each node, in sorted parts.

    A part is the first digits of the MD5 of the neighbour's name, at every
    degree, so no row or task has to hold all neighbours of a hub; ``degree``
    counts the node's neighbours over all parts."""
    both = (edges.select(F.col("dst").alias("node_name"), F.lit("in").alias("direction"),
                         F.col("src").alias("nb"))
            .unionByName(edges.select(F.col("src").alias("node_name"), F.lit("out").alias("direction"),
                                      F.col("dst").alias("nb"))))
    parts = both.groupBy("node_name", "direction", F.substring(F.md5("nb"), 1, PART_DIGITS).alias("part")).agg(
        F.array_sort(F.collect_list("nb")).alias("neighbours"))
    # summed over parts, a bounded number of rows per node
    degrees = parts.groupBy("node_name", "direction").agg(F.sum(F.size("neighbours").cast("long")).alias("degree"))
    return parts.join(degrees, ["node_name", "direction"])


# G-2 / G-5 -------------------------------------------------------------------
def peel(nodes: DataFrame | None, edges: DataFrame):
    """Kahn-style peeling.  Returns (levels, remaining): ``levels`` has every
    node removed at round k with ``level = k`` (its longest path from a
    source); ``remaining`` holds the nodes that sit on or behind a cycle."""
    ensure_checkpoint_dir(edges.sparkSession)
    # materialise the inputs once; every round reads them
    e = edges.select("src", "dst").distinct().checkpoint(eager=True)
    remaining = all_nodes(nodes, e).checkpoint(eager=True)
    removed_parts = []
    for rnd in itertools.count():
        # nodes with no incoming edge among what is left.  Checkpointed (not
        # cached): it is tested and then used twice, and as a plan leaf it
        # keeps the next round's plan from embedding this round's twice.
        # (distinct targets first: a hub with many in-edges is one row)
        sources = remaining.join(e.select(F.col("dst").alias("node_name")).distinct(), "node_name", "left_anti") \
            .checkpoint(eager=True)
        if sources.isEmpty():
            break
        removed_parts.append(sources.withColumn("level", F.lit(rnd).cast("long")))
        remaining = _cut(remaining.join(sources, "node_name", "left_anti"), rnd + 1)
        e = _cut(e.join(sources.select(F.col("node_name").alias("src")), "src", "left_anti"), rnd + 1)
    if removed_parts:
        levels = removed_parts[0]
        for p in removed_parts[1:]:
            levels = levels.unionByName(p)
    else:
        levels = edges.sparkSession.createDataFrame([], "node_name string, level long")
    return levels, remaining


def cyclic_core(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle (or on a path between cycles): peel nodes with no
    incoming edge, then - on what is left - nodes with no outgoing edge.
    Every node that survives both passes has a predecessor and a successor
    inside the survivors, so two passes reach the fixed point."""
    e = edges.select("src", "dst").distinct().checkpoint(eager=True)
    _, rem = peel(nodes, e)
    # keep only edges inside what is left, reverse them, and peel again
    e_in = e.join(rem.select(F.col("node_name").alias("src")), "src", "left_semi") \
            .join(rem.select(F.col("node_name").alias("dst")), "dst", "left_semi")
    rev = e_in.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    _, core = peel(rem, rev)
    return core


# G-3 / G-4 -------------------------------------------------------------------
def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rule violations of a pipeline graph, one row each: ``rule, src, dst``.

    * metadata-store successors must be resource nodes;
    * resource successors must be action nodes;
    * every successor must be registered;
    * at most one metadata store."""
    t = nodes.select("node_name", "base_type")
    j = (edges.select("src", "dst")
         .join(t.select(F.col("node_name").alias("src"), F.col("base_type").alias("src_type")), "src", "left")
         .join(t.select(F.col("node_name").alias("dst"), F.col("base_type").alias("dst_type")), "dst", "left"))
    rule = (F.when(F.col("dst_type").isNull(), F.lit("unregistered_successor"))
            .when((F.col("src_type") == S.BASE_METADATA) & (F.col("dst_type") != S.BASE_RESOURCE),
                  F.lit("store_successor_not_resource"))
            .when((F.col("src_type") == S.BASE_RESOURCE) & (F.col("dst_type") != S.BASE_ACTION),
                  F.lit("resource_successor_not_action")))
    edge_rules = j.select(rule.alias("rule"), "src", "dst").where(F.col("rule").isNotNull())
    stores = t.where(F.col("base_type") == S.BASE_METADATA)
    n_stores = stores.count()                 # one scalar
    many = (stores.where(F.lit(n_stores > 1))
            .select(F.lit("multiple_metadata_stores").alias("rule"), F.col("node_name").alias("src"),
                    F.lit(None).cast("string").alias("dst")))
    return edge_rules.unionByName(many)


# G-7 -----------------------------------------------------------------------
def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything reachable from each seed, with the fewest hops.

    Frontier expansion: join the frontier to the edges, drop what each seed
    has already visited (anti join on (seed, node)), repeat until empty.
    The result is seeds times what each reaches: pass the seeds that are asked
    for, not the node table."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("src", "dst").distinct().checkpoint(eager=True)     # read by every round
    frontier = seeds.select(F.col("node_name").alias("seed"), F.col("node_name").alias("node"),
                            F.lit(0).cast("long").alias("depth")).distinct()
    visited = frontier
    for rnd in itertools.count(1):
        nxt = (frontier.join(e, frontier.node == e.src)
               .select("seed", F.col("dst").alias("node"))
               .distinct()
               .join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
               .withColumn("depth", F.lit(rnd).cast("long")))
        nxt = nxt.checkpoint(eager=True)      # tested, then reused; a plan leaf
        if nxt.isEmpty():
            break
        visited = _cut(visited.unionByName(nxt), rnd)
        frontier = nxt
    return visited


# U-2 -----------------------------------------------------------------------
def merge_graphs(graphs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Union several (name, nodes, edges) graphs; per node: its base type (from
    any graph that registers it) and how many graphs mention it."""
    parts = []
    for name, nodes, edges in graphs:
        mention = all_nodes(nodes, edges).withColumn("graph", F.lit(name))
        parts.append(mention.join(nodes.select("node_name", "base_type"), "node_name", "left"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("node_name").agg(F.min("base_type").alias("base_type"),
                                      F.countDistinct("graph").alias("n_graphs"))
