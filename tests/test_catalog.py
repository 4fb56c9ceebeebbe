"""Catalog reads and writes: filters, errors-as-rows, dense bulk ids."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runledger import schemas as S
from runledger.operators import catalog as C
from runledger.operators import docstore as DS
from runledger.operators import writes as K
from runledger.operators.ids import assign_ids


def _nodes(spark):
    return spark.createDataFrame([(1, "data_store", "FilesystemStoreNode", "BaseResourceNode"),
                                  (2, "model_store", "FilesystemStoreNode", "BaseResourceNode")],
                                 "id long, node_name string, node_type string, base_type string")


def _arts(spark):
    return spark.createDataFrame(
        [(1, None, 1, "test_file0.txt", None, "new", "h0", "sha256", 11, "text/plain"),
         (2, 0, 1, "test_file1.txt", None, "used", "h1", "sha256", 11, "text/plain"),
         (3, 0, 2, "model0.txt", None, "produced", "h2", "sha256", 5, "text/plain"),
         (4, 1, 2, "model0.txt", None, "produced", "h3", "sha256", 5, "text/plain")],
        "id long, run_id long, node_id long, location string, created_at timestamp_ntz, state string, "
        "hash string, hash_algorithm string, size long, content_type string")


def test_entries_filters_and_errors(spark):
    e = C.entries(_arts(spark), _nodes(spark), node_name="data_store", state="new")
    assert [r.location for r in e.collect()] == ["test_file0.txt"]
    assert C.entries(_arts(spark), _nodes(spark), run_id=0).count() == 2
    with pytest.raises(ValueError):
        C.entries(_arts(spark), _nodes(spark), run_id=-1)
    with pytest.raises(ValueError):
        C.entries(_arts(spark), _nodes(spark), state="current")


def test_num_entries_has_all_row(spark):
    got = {(r.node_name, r.state): r.num_entries for r in C.num_entries(_arts(spark), _nodes(spark)).collect()}
    assert got[("data_store", "all")] == 2 and got[("data_store", "new")] == 1
    assert got[("model_store", "all")] == 2 and got[("model_store", "produced")] == 2


def test_artifact_hash_tie_goes_to_lowest_id(spark):
    req = spark.createDataFrame([("model_store", "model0.txt"), ("model_store", "nope")], "node_name string, location string")
    got = {r.location: (r.id, r.hash) for r in C.artifact_hash(_arts(spark), _nodes(spark), req).collect()}
    assert got == {"model0.txt": (3, "h2"), "nope": (None, None)}


def test_node_ids_reports_unknown(spark):
    names = spark.createDataFrame([("data_store",), ("ghost",)], "node_name string")
    got = {r.node_name: (r.id, r.found) for r in C.node_ids(_nodes(spark), names).collect()}
    assert got == {"data_store": (1, True), "ghost": (None, False)}


def test_register_nodes_rejects_known(spark):
    new = spark.createDataFrame([("data_store", "X", "BaseResourceNode"), ("trainer", "A", "BaseActionNode"),
                                 ("evaluator", "A", "BaseActionNode")], "node_name string, node_type string, base_type string")
    got = {r.node_name: (r.id, r.accepted) for r in K.register_nodes(_nodes(spark), new).collect()}
    assert got == {"data_store": (None, False), "evaluator": (3, True), "trainer": (4, True)}


def test_insert_artifacts_duplicates_and_using_run(spark):
    new = spark.createDataFrame(
        [("data_store", "test_file1.txt", "h9", "sha256", "new", None, 1, "t"),      # already catalogued
         ("data_store", "test_file2.txt", "hb", "sha256", "using", None, 1, "t"),    # new, takes current run
         ("data_store", "test_file2.txt", "ha", "sha256", "using", None, 1, "t"),    # same key in batch
         ("model_store", "model1.txt", "hc", "sha256", "produced", 1, 1, "t")],
        "node_name string, location string, hash string, hash_algorithm string, state string, run_id long, "
        "size long, content_type string")
    rows = K.insert_artifacts(_arts(spark), _nodes(spark), new, current_run_id=7).collect()
    assert len(rows) == new.count()
    acc = {(r.location, r.hash): (r.id, r.run_id) for r in rows if r.accepted}
    rej = {(r.location, r.hash) for r in rows if not r.accepted}
    assert acc == {("test_file2.txt", "ha"): (5, 7), ("model1.txt", "hc"): (6, 1)}
    assert rej == {("test_file1.txt", "h9"), ("test_file2.txt", "hb")}


def test_inserts_conserve_rows_and_can_be_appended(spark, tmp):
    row = ("data_store", "a.txt", "h1", "sha256", "new", None, 1, "t")
    new = spark.createDataFrame([row, row, row[:4] + ("used", 3, 1, "t"), ("ghost",) + row[1:], ("data_store", None) + row[2:]],
                                "node_name string, location string, hash string, hash_algorithm string, state string, run_id long, "
                                "size long, content_type string")
    out = K.insert_artifacts(_arts(spark), _nodes(spark), new)
    assert sorted(str(r.reason) for r in out.collect()) == \
        ["None", "incomplete key", "repeated in batch", "repeated in batch", "unknown node"]
    paths = K.create_catalog(spark, f"{tmp}/cat")
    K.append(K.rows_to_append(out, "artifacts"), paths["artifacts"])
    back = spark.read.schema(S.CATALOG["artifacts"]).parquet(paths["artifacts"]).collect()
    assert [(r.location, r.state, r.size) for r in back] == [("a.txt", "new", 1)]


def test_assign_ids_dense_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5003).alias("k"))
    out = assign_ids(df, ["k"], 100).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(101, 5101))
    by_k = sorted(out, key=lambda r: r.k)
    assert [r.id for r in by_k] == list(range(101, 5101))


def test_merge_catalog_resets_state(spark):
    leaf = spark.createDataFrame([("test_file0.txt", "hx", "sha256", 1, "t", 3), ("leaf_1.txt", "hy", "sha256", 1, "t", 3)],
                                 "location string, hash string, hash_algorithm string, size long, content_type string, run_id long")
    got = {r.location: (r.state, r.accepted) for r in K.merge_catalog(_arts(spark), _nodes(spark), leaf, "data_store").collect()}
    assert got == {"test_file0.txt": ("new", False), "leaf_1.txt": ("new", True)}


def test_log_metrics_keeps_nulls_and_params_are_strings(spark):
    calls = spark.createDataFrame([(0, "leaf", 1.0, None)], "run_id long, node string, acc double, loss double")
    got = {(r.metric_name, r.metric_value) for r in K.log_metrics(calls, ["run_id", "node"], ["acc", "loss"]).collect()}
    assert got == {("acc", 1.0), ("loss", None)}
    p = spark.createDataFrame([(0, 64, 3e-4)], "run_id long, batch_size int, learning_rate double")
    got = {(r.param_name, r.param_value) for r in K.log_params(p, ["run_id"], ["batch_size", "learning_rate"]).collect()}
    assert got == {("batch_size", "64"), ("learning_rate", "3.0E-4")}


def test_tag_artifacts_rejects_missing(spark):
    req = spark.createDataFrame([("data_store", "test_file0.txt", "shakespeare run"), ("data_store", "gone.txt", "x")],
                                "node_name string, location string, test_name string")
    got = {r.location: (r.artifact_id, r.accepted) for r in K.tag_artifacts(_arts(spark), _nodes(spark), req, ["test_name"]).collect()}
    assert got == {"test_file0.txt": (1, True), "gone.txt": (None, False)}


def test_card_links_are_mutual(spark):
    links = spark.createDataFrame([("model0.txt", "model0_card.md")], "subject string, card string")
    got = {(r.location, r.tag_name, r.tag_value) for r in K.card_links(links, "model_path", "model_card_path").collect()}
    assert got == {("model0.txt", "model_card_path", "model0_card.md"), ("model0_card.md", "model_path", "model0.txt")}


def test_doc_store_query_and_update(spark):
    docs = spark.createDataFrame([(1, "metric", '{"k": 5}'), (2, "metric", '{"k": 60}'), (3, "node", '{"k": 60}')],
                                 "id long, type string, payload string").withColumn("payload", F.parse_json("payload"))
    assert [r.id for r in K.doc_query(docs, "metric", k=60).collect()] == [2]
    more = docs.unionByName(spark.createDataFrame([(4, "metric", '{"k": "abc", "deep": {"x": [1, null]}}'), (5, "metric", "[1]"), (6, "metric", None)],
                                                  "id long, type string, payload string").withColumn("payload", F.parse_json("payload")))
    got = {r.id: (json.loads(r.p) if r.p else None, r.updated) for r in
           K.doc_update(more, {"status": "triaged", "n": 2}, "metric", k=60).withColumn("p", F.to_json("payload")).collect()}
    assert got == {1: ({"k": 5}, False), 2: ({"k": 60, "status": "triaged", "n": 2}, True), 3: ({"k": 60}, False),
                   4: ({"k": "abc", "deep": {"x": [1, None]}}, False), 5: ([1], False), 6: (None, False)}
    by_id = {r.id: r.p for r in K.doc_update(more, {"k": 7}, doc_id=4).withColumn("p", F.to_json("payload")).collect()}
    assert json.loads(by_id[4]) == {"k": 7, "deep": {"x": [1, None]}} and json.loads(by_id[1]) == {"k": 5}


def test_doc_filters_by_kind(spark):
    rows = ['{"a": null}', "{}", '{"a": "None"}', '{"a": true}', '{"a": "True"}', '{"a": 1}', '{"a": "1"}', '{"a": 1.5}',
            '{"a": "2024-01-02T00:00:00"}', "[1]", None, '{"a": {"b": 1}, "x.y": 2, "q\'": 3, "r\'\\"": 4}']
    docs = spark.createDataFrame([(i, "t", r) for i, r in enumerate(rows)], "id long, type string, payload string").withColumn(
        "payload", F.parse_json("payload"))

    def ids(**f):
        return [r.id for r in DS.find(docs, f).orderBy("id").collect()]

    assert ids(a=None) == [0, 1, 9, 10] and ids(a="None") == [2]
    assert ids(a=True) == [3] and ids(a="True") == [4] and ids(a=False) == []
    assert ids(a=1) == [5] and ids(a="1") == [6] and ids(a=1.5) == [7] and ids(a=1.0) == [5]
    assert ids(a=("$lt", 1.5)) == [5] and ids(a=("$gte", 1)) == [5, 7] and ids(a=("$lt", None)) == []
    assert ids(a=("$lt", dt.datetime(2024, 1, 3))) == [8] and ids(a=dt.datetime(2024, 1, 2)) == [8]
    assert ids(a=("$in", [1, "1", None])) == [0, 1, 5, 6, 9, 10] and ids(a=("$exists", True)) == [0, 2, 3, 4, 5, 6, 7, 8, 11]
    assert ids(a=("$ne", 1)) == [i for i in range(12) if i != 5] and ids(a=("$nin", [True, None])) == [2, 4, 5, 6, 7, 8, 11]
    assert ids(**{"$or": [{"a": 1}, {"x.y": 2}]}) == [5, 11] and ids(**{"$not": {"a": None}, "id": ("$gt", 8)}) == [11]
    assert ids(**{"q'": 3, "type": "t", "r'\"": 4}) == [11] and ids(**{"$or": []}) == [] and ids(**{"$and": []}) == list(range(12))
    with pytest.raises(ValueError):
        ids(a=("$near", 1))


def test_field_log_folds_by_seq(spark):
    docs = spark.createDataFrame([(1, "t", '{"a": 1, "b": 2}'), (2, "t", "[1]"), (3, "t", None), (4, "t", "{}")],
                                 "id long, type string, payload string").withColumn("payload", F.parse_json("payload"))
    log = spark.createDataFrame([(1, "a", "5", 2), (1, "a", "4", 1), (1, "c", '{"d": [null]}', 1), (1, "a", "5", 2), (2, "a", "1", 1),
                                 (3, "a", "1", 1), (4, "b", "null", 3), (9, "a", "1", 1)], DS.LOG_SCHEMA)
    got = {r.id: r.p and json.loads(r.p) for r in DS.fold_log(docs, log).withColumn("p", F.to_json("payload")).collect()}
    assert got == {1: {"a": 5, "b": 2, "c": {"d": [None]}}, 2: [1], 3: None, 4: {"b": None}}
    made = DS.update_log(docs, {"a": 1}, {"a": None, "s": "x", "n": F.col("id") * 2}, 7).collect()
    assert sorted(tuple(r) for r in made) == [(1, "a", "null", 7), (1, "n", "2", 7), (1, "s", '"x"', 7)]
    assert DS.fold_log(docs, log.limit(0)).count() == 4


def test_nodes_info_id_wins_or_and(spark):
    n = _nodes(spark)
    assert [r.node_name for r in C.nodes_info(n, node_id=1, node_name="model_store").collect()] == ["data_store"]
    assert C.nodes_info(n, node_id=1, node_name="model_store", both="and").count() == 0


def test_operators_on_an_empty_stored_catalog(spark, tmp):
    from runledger import schemas as S
    from runledger.operators import fingerprint as FP
    from runledger.operators import runs as R
    from runledger.sources.tables import read_catalog_table
    root = tmp + "/cat"
    K.create_catalog(spark, root)
    cat = {t: read_catalog_table(spark, f"{root}/{t}", schema) for t, schema in S.CATALOG.items()}
    assert C.entries(cat["artifacts"], cat["nodes"], node_name="x", state="new").count() == 0
    assert C.num_entries(cat["artifacts"], cat["nodes"]).count() == 0
    assert R.assign_triggers(cat["triggers"], cat["runs"]).count() == 0
    assert FP.run_hash(cat["runs"], cat["artifacts"], cat["metrics"], cat["params"], cat["tags"]).count() == 0
    assert R.current_run(cat["runs"]).first()["run_id"] == 0
