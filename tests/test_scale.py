"""Plans and amounts of work that must not grow faster than the input."""

from pyspark.sql import functions as F

from runledger.operators import templates as TP


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cards_of_one_template_are_not_broadcast(spark):
    # a template named by a constant leaves the join without a key
    cards = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("card_id"), F.lit("dataset").alias("template"),
                                     F.create_map(F.lit("pretty_name"), F.concat(F.lit("n"), "id")).alias("fields"))
    out = TP.render_cards(cards, TP.template_parts(TP.default_templates(spark)))
    assert "BuildLeft" not in plan_of(out) and "BuildRight" in plan_of(out)
    assert out.where(F.contains("text", F.concat(F.lit("# Dataset Card for n"), F.substr("card_id", F.lit(2))))).count() == 1000


def test_a_plain_line_after_a_block_text(spark):
    # it ended the job before: no list mark or key to take its column from
    from runledger.operators import headers as H
    text = "---\na: |\n  x\nplain\nb: 1\n---\nBody"
    cards = H.split_header(spark.createDataFrame([("c", text)], "card_id string, text string"))
    assert H.cards_from_rows(cards, H.header_rows(cards)).first().content == text
    assert [(r.p, r.value) for r in H.header_paths(cards).select(H.path_text("path").alias("p"), "value").collect()] == [
        ("a", "x\nain\n"), ("b", "1")]


def test_headers_are_read_once_per_use(spark):
    # the header's lines are one expression of the plan, not copies of it in filters
    from runledger.operators import cards as CD
    from runledger.operators import headers as H
    cards = H.split_header(spark.createDataFrame([("c", "---\na: 1\n---\n")], "card_id string, text string"))
    plan = plan_of(CD.model_index_flatten(H.model_index_from_cards(cards)))
    assert plan.count("_json_of(") <= 2 and "aggregate(" not in plan


def test_run_ends_of_a_node_are_not_one_array(spark):
    from runledger.streaming import cycle as CY
    # several run ends at one time, arrivals with them, a node without arrivals
    events = [("a", t, k) for t in range(60) for k in ["file"] * (t % 4) + ["run_end"] * (t % 3)] + [("b", 1, "run_end")] * 3
    df = spark.createDataFrame(events, "node_name string, at long, kind string")
    folded = CY.fold_cycle(df, spark.createDataFrame([], CY.STATE_SCHEMA), 3)
    assert "collect_list" not in plan_of(folded)
    want, waiting, fired = [], 0, False
    for _, _, kind in sorted([e for e in events if e[0] == "a"], key=lambda e: (e[1], e[2] != "run_end")):
        waiting += kind == "file"
        if (kind == "run_end" and fired or kind == "file" and not fired) and waiting >= 3:
            want.append(("a", len(want) + 1, waiting, "run_end" if kind == "run_end" else "arrivals"))
            waiting, fired = 0, True
        elif kind == "run_end":
            fired = False
    assert sorted(tuple(r) for r in CY.fires(folded).collect()) == want
    assert {r.node_name: r.waiting for r in folded.where("cause IS NULL").collect()} == {"a": waiting, "b": 0}


def test_texts_meet_python_in_bounded_batches(spark, tmp):
    import pandas as pd

    from runledger.sources import files as FS
    rows = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("d/"), "id").alias("rel"), F.when(F.col("id") == 7, F.repeat(F.lit("x"), 3 << 20)).otherwise(
        F.concat(F.lit("text "), "id")).alias("text"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    with FS._small_batches(spark):
        assert rows.mapInPandas(sizes, "n long").agg(F.max("n")).first()[0] <= FS.BATCH_ROWS
    assert FS.write_text_files(rows, tmp) == 1000 and spark.conf.get(key) == before
    back = FS.artifact_text(spark, tmp).join(rows, F.concat_ws("/", "node_name", "location") == F.col("rel"))
    assert back.where("content = text").count() == 1000
