"""Pipeline graphs as tables (the reference's small demo DAG and chains)."""

from runledger.operators import graph as G

SMALL = [("metadata_store", "haiku_data_store"), ("metadata_store", "model_registry"),
         ("metadata_store", "plots_store"), ("haiku_data_store", "retraining"), ("model_registry", "retraining"),
         ("plots_store", "retraining"), ("retraining", "shakespeare_eval"), ("retraining", "haiku_eval")]
TYPES = [("metadata_store", "BaseMetadataStoreNode"), ("haiku_data_store", "BaseResourceNode"),
         ("model_registry", "BaseResourceNode"), ("plots_store", "BaseResourceNode"),
         ("retraining", "BaseActionNode"), ("shakespeare_eval", "BaseActionNode"), ("haiku_eval", "BaseActionNode")]


def test_levels_of_demo_graph(spark):
    e = spark.createDataFrame(SMALL, "src string, dst string")
    levels, rem = G.peel(None, e)
    got = {r.node_name: r.level for r in levels.collect()}
    assert got["metadata_store"] == 0 and got["plots_store"] == 1 and got["retraining"] == 2
    assert got["haiku_eval"] == 3 and rem.count() == 0


def test_cycle_core(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src string, dst string")
    assert sorted(r.node_name for r in G.cyclic_core(None, e).collect()) == ["a", "b", "c"]


def test_violations(spark):
    e = spark.createDataFrame(SMALL + [("metadata_store", "retraining"), ("plots_store", "ghost")], "src string, dst string")
    n = spark.createDataFrame(TYPES + [("other_store", "BaseMetadataStoreNode")], "node_name string, base_type string")
    got = {(r.rule, r.src, r.dst) for r in G.violations(n, e).collect()}
    assert ("store_successor_not_resource", "metadata_store", "retraining") in got
    assert ("unregistered_successor", "plots_store", "ghost") in got
    assert ("multiple_metadata_stores", "other_store", None) in got
    assert len(got) == 4


def test_downstream_min_depth(spark):
    e = spark.createDataFrame([("root", "leaf1"), ("leaf1", "leaf2"), ("root", "leaf2")], "src string, dst string")
    seeds = spark.createDataFrame([("root",)], "node_name string")
    got = {(r.node, r.depth) for r in G.downstream(e, seeds).collect()}
    assert got == {("root", 0), ("leaf1", 1), ("leaf2", 1)}


def test_neighbour_lists_part_every_degree(spark):
    e = spark.createDataFrame([("hub", f"n{i:02d}") for i in range(25)], "src string, dst string")
    out = G.neighbour_lists(e).where("node_name = 'hub'").collect()
    assert sorted(n for r in out for n in r.neighbours) == [f"n{i:02d}" for i in range(25)]
    assert all(r.neighbours == sorted(r.neighbours) and r.degree == 25 for r in out)
    assert len({r.part for r in out}) == len(out) > 1


def test_long_chain_is_peeled_to_its_end(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "src string, dst string")
    levels, rest = G.peel(None, e)
    assert {r.node_name: r.level for r in levels.collect()} == {f"n{i:02d}": i for i in range(13)} and rest.isEmpty()
    assert G.downstream(e, spark.createDataFrame([("n00",)], "node_name string")).count() == 13


def test_edges_from_predecessors(spark):
    d = spark.createDataFrame([("retraining", ["haiku_data_store", "plots_store"])], "name string, predecessors array<string>")
    assert {(r.src, r.dst) for r in G.edges_from_predecessors(d).collect()} == \
        {("haiku_data_store", "retraining"), ("plots_store", "retraining")}


def test_merge_graphs(spark):
    n1 = spark.createDataFrame([("root", "BaseMetadataStoreNode")], "node_name string, base_type string")
    e1 = spark.createDataFrame([("root", "leaf1")], "src string, dst string")
    n2 = spark.createDataFrame([("leaf1", "BaseActionNode")], "node_name string, base_type string")
    e2 = spark.createDataFrame([("leaf1", "leaf2")], "src string, dst string")
    got = {r.node_name: (r.base_type, r.n_graphs) for r in G.merge_graphs([("a", n1, e1), ("b", n2, e2)]).collect()}
    assert got == {"root": ("BaseMetadataStoreNode", 1), "leaf1": ("BaseActionNode", 2), "leaf2": (None, 1)}
