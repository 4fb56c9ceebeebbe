"""Cards: model index round trip, eval checks, front matter, rendering."""

from pyspark.sql import functions as F

from runledger import schemas as S
from runledger.functions.text import line_ending
from runledger.operators import cards as CD

EVAL_SCHEMA = ("seq long, model_name string, task_type string, task_name string, dataset_type string, "
               "dataset_name string, dataset_config string, dataset_split string, dataset_revision string, "
               "metric_type string, metric_value double, metric_name string, metric_config string, "
               "verified boolean, verify_token string, source_name string, source_url string")


def _evals(spark):
    return spark.createDataFrame([
        (1, "my-cool-model", "image-classification", None, "beans", "Beans", None, None, None, "accuracy", 0.9,
         None, None, None, None, None, None),
        (2, "my-cool-model", "image-classification", None, "beans", "Beans", None, None, None, "f1", 0.8,
         None, None, None, None, "board", "https://example.org/board"),
        (3, "my-cool-model", "image-classification", None, "beans", "Beans", None, None, None, "accuracy", 0.7,
         None, None, None, "tok", None, None),
        (4, None, "text-generation", None, "tiny", "Tiny", None, None, None, "loss", None,
         None, None, None, None, "orphan", None)], EVAL_SCHEMA).withColumns(
            {"dataset_args": F.lit(None).cast("string"), "metric_args": F.lit(None).cast("string")})


def test_model_index_groups_by_identity_first_result_wins(spark):
    mi = CD.model_index_build(_evals(spark).where("model_name IS NOT NULL")).collect()
    assert len(mi) == 1 and mi[0].name == "my-cool-model"
    res = mi[0].results
    assert len(res) == 1                          # one (task, dataset) identity
    assert [m.type for m in res[0].metrics] == ["accuracy", "f1", "accuracy"]
    assert res[0].source is None                  # first result had no source URL


def test_model_index_flatten_round_trip(spark):
    e = _evals(spark).where("seq = 1")
    flat = CD.model_index_flatten(CD.model_index_build(e)).collect()
    assert [(r.model_name, r.task_type, r.dataset_type, r.metric_type, r.metric_value) for r in flat] == \
        [("my-cool-model", "image-classification", "beans", "accuracy", 0.9)]


def test_model_index_json_drops_nulls(spark):
    j = CD.model_index_json(CD.model_index_build(_evals(spark).where("seq = 1"))).first().model_index
    assert '"dataset":{"name":"Beans","type":"beans"}' in j and "null" not in j


def test_conflicts_ignore_value_and_token(spark):
    got = {(r.seq, r.first_seq, r.n_in_group) for r in CD.eval_conflicts(_evals(spark)).collect()}
    assert got == {(1, 1, 2), (3, 1, 2)}


def test_args_survive_and_part_conflicts(spark):
    e = _evals(spark).where("seq IN (1, 3)").withColumns({
        "dataset_args": F.lit('{"n":[1,2]}'), "metric_args": F.when(F.col("seq") == 1, '{"average":"macro"}')})
    mi = CD.model_index_build(e)
    text = CD.model_index_json(mi).first().model_index
    assert '"args":{"n":[1,2]}' in text and text.count('"args":{"average":"macro"}') == 1
    back = {r.metric_value: (r.dataset_args, r.metric_args) for r in CD.model_index_flatten(mi).collect()}
    assert back == {0.9: ('{"n":[1,2]}', '{"average":"macro"}'), 0.7: ('{"n":[1,2]}', None)}
    assert CD.eval_conflicts(e).count() == 0           # other arguments: another evaluation


def test_violations(spark):
    got = {(r.seq, r.rule) for r in CD.eval_violations(_evals(spark)).collect()}
    assert got == {(4, "source_name_without_url"), (4, "missing_model_name"), (4, "missing_metric_value")}


CARD = "---\nlanguage: en\nlicense: mit\npretty_name: My Text Classification Dataset\n---\n\n# Dataset Card\n"


def test_front_matter_split_and_reassemble(spark):
    cards = spark.createDataFrame([("c1", CARD), ("c2", "no header\r\nat all"), ("c3", CARD.replace("\n", "\r\n"))],
                                  "card_id string, text string")
    sp = CD.split_front_matter(cards)
    ent = CD.header_entries(sp)
    got = {(r.card_id, r.key): r.value for r in ent.collect()}
    assert got[("c1", "license")] == "mit" and got[("c3", "pretty_name")] == "My Text Classification Dataset"
    bodies = {r.card_id: (r.has_header, r.body) for r in sp.collect()}
    assert bodies["c2"] == (False, "no header\r\nat all") and bodies["c1"][1] == "\n# Dataset Card\n"
    back = {r.card_id: r.content for r in CD.reassemble(sp.where("has_header"), ent).collect()}
    assert back["c1"] == CARD and back["c3"] == CARD.replace("\n", "\r\n")


def test_block_lists_of_the_header_survive(spark):
    text = ("---\nannotations_creators: crowdsourced\nlanguage: en\ntask_categories:\n- text-classification\ntask_ids:\n"
            "- sentiment-classification\n- text-scoring\npretty_name: My Text Classification Dataset\n---\n\n# Card\n")
    sp = CD.split_front_matter(spark.createDataFrame([("c", text), ("none", "no header")], "card_id string, text string"))
    ent = CD.header_entries(sp)
    assert {r.key: (r.value, r["items"]) for r in ent.collect()} == {
        "annotations_creators": ("crowdsourced", []), "language": ("en", []), "task_categories": ("", ["text-classification"]),
        "task_ids": ("", ["sentiment-classification", "text-scoring"]), "pretty_name": ("My Text Classification Dataset", [])}
    assert CD.reassemble(sp.where("has_header"), ent).first().content == text


def test_line_endings(spark):
    df = spark.createDataFrame([("a\nb",), ("a\r\nb",), ("a\rb\rc\n",), ("ab",)], "t string")
    got = [r[0] for r in df.select(line_ending("t")).collect()]
    assert got == ["\n", "\r\n", "\r", None]


def test_render_uses_placeholder(spark):
    meta = spark.createDataFrame([("d", "My Text Classification Dataset", ["en"], "mit", None, None, None)],
                                 "card_id string, pretty_name string, language array<string>, license string, "
                                 "size_categories string, curated_by string, repository string")
    text = CD.render_dataset_cards(meta).first().text
    assert text.startswith("---\nlanguage: [en]\nlicense: mit\npretty_name: My Text Classification Dataset\n---\n")
    assert "- **Curated by:** " + S.MORE_INFO_NEEDED in text
    assert "- **License:** mit" in text and "# Dataset Card for My Text Classification Dataset" in text


def test_dataset_cards_list_all_files_in_parts(spark):
    nodes = spark.createDataFrame([(1, "ds")], "id long, node_name string")
    arts = spark.createDataFrame([(i, 1, f"f{i:03d}.txt", "text/plain", f"h{i}") for i in range(50)],
                                 "id long, node_id long, location string, content_type string, hash string")
    small, big = (CD.dataset_cards(arts, nodes, "2024-02-01", **kw) for kw in ({}, {"part_files": 7}))
    assert small.count() == 1 and big.count() > 1
    for cards in (small, big):
        got = CD.card_distribution(cards).collect()
        assert sorted((r.name, r.type, r.sha256) for r in got) == [(f"f{i:03d}.txt", "cr:FileObject", f"h{i}") for i in range(50)]
        assert CD.card_record_fields(cards).count() == 2


def test_unique_tags_keep_first_seen_order(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "tags array<string>")
    assert CD.unique_tags(df).first().tags == ["b", "a", "c"]


def test_dataset_card_metadata_renames_keys(spark):
    meta = spark.createDataFrame([("d", "en", "mit", ["text-classification"], "cfg")],
                                 "card_id string, language string, license string, task_categories array<string>, "
                                 "train_eval_index string")
    j = CD.dataset_card_metadata(meta).first().metadata
    assert '"train-eval-index":"cfg"' in j and "train_eval_index" not in j and '"license":"mit"' in j


def test_model_registry_view_keeps_models_without_card(spark):
    models = spark.createDataFrame([("a", "model0.txt"), ("b", "model0.txt"), ("a", "model1.txt")], "node_name string, location string")
    links = spark.createDataFrame([("a", "model0.txt", "model_card_path", "model0_card.md")],
                                  "node_name string, location string, tag_name string, tag_value string")
    got = {(r.node_name, r.location): r.card_location for r in CD.model_registry_view(models, links).collect()}
    assert got == {("a", "model0.txt"): "model0_card.md", ("b", "model0.txt"): None, ("a", "model1.txt"): None}


def test_write_cards_one_file_each(spark, tmp):
    import os
    cards = spark.createDataFrame([("a", "---\nx: 1\n---\nbody"), ("b", "plain")], "card_id string, text string")
    assert CD.write_cards(cards, tmp) == 2
    assert open(os.path.join(tmp, "a.md")).read() == "---\nx: 1\n---\nbody"
    import pytest
    with pytest.raises(Exception):
        CD.write_cards(cards, tmp, overwrite=False)
