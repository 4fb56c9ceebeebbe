"""Action hooks and outcome classification (X-1 .. X-6)."""

from runledger.driver import Action, RunCycle, RunHooks, run_action, run_actions


def test_outcomes_and_hook_order(spark):
    calls = []
    ok = Action("train", lambda s, r, i: True, before_execution=lambda: calls.append("before"),
                after_execution=lambda: calls.append("after"), on_success=lambda: calls.append("success"))
    assert run_action(spark, ok, 0)["status"] == "COMPLETE"
    assert calls == ["before", "success", "after"]

    def boom(s, r, i):
        raise RuntimeError("bad")
    errs = []
    bad = Action("eval", boom, on_error=lambda e: errs.append(str(e)))
    out = run_action(spark, bad, 0)
    assert out["status"] == "ERROR" and out["signal"] == "FAILURE" and errs == ["bad"]
    assert run_action(spark, Action("noop", lambda s, r, i: None), 0)["status"] == "FAILURE"


def test_run_actions_and_run_hooks(spark):
    seen = []
    df = run_actions(spark, [Action("a", lambda s, r, i: True), Action("b", lambda s, r, i: False)], 4,
                     hooks=RunHooks(before_run_starts=seen.append, before_run_ends=seen.append))
    assert {(r.node_name, r.status) for r in df.collect()} == {("a", "COMPLETE"), ("b", "FAILURE")}
    assert seen == [4, 4]


def test_run_cycle_waits_for_all_inputs(spark):
    nodes = spark.createDataFrame([(1, "s1"), (2, "s2")], "id long, node_name string")
    arts = spark.createDataFrame([(1, 1, "new"), (2, 1, "new")], "id long, node_id long, state string")
    cyc = RunCycle(required_nodes=["s1", "s2"])
    assert not cyc.ready(cyc.fired(arts, nodes))
    arts2 = arts.unionByName(spark.createDataFrame([(3, 2, "new")], "id long, node_id long, state string"))
    assert cyc.ready(cyc.fired(arts2, nodes))


def test_run_cycle_with_metric_trigger(spark):
    from runledger.driver import default_metric_trigger
    nodes = spark.createDataFrame([(1, "s1"), (2, "edge_deployment_client")], "id long, node_name string")
    arts = spark.createDataFrame([(1, 1, "new")], "id long, node_id long, state string")
    cyc = RunCycle(required_nodes=["s1", "edge_deployment_client"],
                   metric_trigger=default_metric_trigger(0.4, "percent_accuracy"))
    low = spark.createDataFrame([(i, 0, 2, "percent_accuracy", 0.1 * i) for i in range(5)],
                                "id long, run_id long, node_id long, metric_name string, metric_value double")
    assert not cyc.ready(cyc.fired(arts, nodes, low))           # max is 0.4: not strictly above
    high = low.unionByName(spark.createDataFrame([(5, 0, 2, "percent_accuracy", 0.5)], low.schema))
    assert cyc.ready(cyc.fired(arts, nodes, high))
