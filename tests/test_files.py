"""File sources on the reference's demo files (10 x "test file {i}")."""

import hashlib
import os

import pytest

from runledger.operators import writes as K
from runledger.sources import files as FS


def _make_tree(root, node="data_store", n=10, prefix="test_file"):
    os.makedirs(os.path.join(root, node), exist_ok=True)
    for i in range(n):
        with open(os.path.join(root, node, f"{prefix}{i}.txt"), "w") as f:
            f.write(f"test file {i}")


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_scan_hashes_and_keys(spark, tmp):
    _make_tree(tmp)
    got = {(r.node_name, r.location): (r.size, r.hash) for r in FS.scan_artifacts(spark, tmp).collect()}
    assert got == {("data_store", f"test_file{i}.txt"): (11, _sha(f"test file {i}")) for i in range(10)}


def test_chunked_hash_for_large_files(spark, tmp):
    _make_tree(tmp)
    big = "x" * (3 * (1 << 20) + 17)            # three full chunks and a tail
    with open(os.path.join(tmp, "data_store", "big.bin"), "w") as f:
        f.write(big)
    got = {r.location: r.hash for r in FS.scan_artifacts(spark, tmp).collect()}
    assert got["big.bin"] == _sha(big) and got["test_file3.txt"] == _sha("test file 3")


def test_new_artifacts_only_unknown_paths(spark, tmp):
    _make_tree(tmp)
    known = spark.createDataFrame([("data_store", f"test_file{i}.txt") for i in range(6)], "node_name string, location string")
    got = sorted(r.location for r in FS.new_artifacts(spark, tmp, known).collect())
    assert got == [f"test_file{i}.txt" for i in range(6, 10)]


def test_all_kinds_of_files_are_listed_hashed_and_read(spark, tmp):
    _make_tree(tmp, n=3)
    names = {"data_store/empty.txt": "", "data_store/.hidden": "h", "data_store/_part": "p", "data_store/a b%20c.txt": "s",
             "data_store/_sub/deep/\u00e9.txt": "e", "root.txt": "r"}
    for n, t in names.items():
        os.makedirs(os.path.dirname(os.path.join(tmp, n)) or tmp, exist_ok=True)
        with open(os.path.join(tmp, n), "w") as f:
            f.write(t)
    want = {(n.split("/", 1)[0] if "/" in n else None, n.split("/", 1)[-1]): t
            for n, t in {**names, **{f"data_store/test_file{i}.txt": f"test file {i}" for i in range(3)}}.items()}
    scanned = FS.scan_artifacts(spark, tmp)
    assert {(r.node_name, r.location): r.hash for r in scanned.collect()} == {k: _sha(t) for k, t in want.items()}
    assert {(r.node_name, r.location): r.content for r in FS.artifact_text(spark, tmp).collect()} == want
    assert sorted(r.key for r in FS.object_listing(spark, tmp).collect()) == sorted("/".join(filter(None, k)) for k in want)
    checked = FS.verify_artifacts(scanned, scanned.select("node_name", "location", "hash").where("node_name IS NOT NULL"))
    assert {r.status for r in checked.where("location != 'root.txt'").collect()} == {"ok"}
    known = spark.createDataFrame([k for k in want if k[1] != ".hidden"], "node_name string, location string")
    assert [r.location for r in FS.new_artifacts(spark, f"file:{tmp}", known).collect()] == [".hidden"]


def test_hashing_runs_in_many_tasks(spark, tmp):
    _make_tree(tmp, n=60)
    assert FS.scan_artifacts(spark, tmp).rdd.getNumPartitions() > 1


def test_verify_statuses(spark, tmp):
    _make_tree(tmp)
    with open(os.path.join(tmp, "data_store", "test_file1.txt"), "w") as f:
        f.write("tampered")
    os.remove(os.path.join(tmp, "data_store", "test_file2.txt"))
    cat = spark.createDataFrame([("data_store", f"test_file{i}.txt", _sha(f"test file {i}")) for i in range(3)],
                                "node_name string, location string, hash string")
    got = {r.location: r.status for r in FS.verify_artifacts(FS.scan_artifacts(spark, tmp), cat).collect()}
    assert got["test_file0.txt"] == "ok" and got["test_file1.txt"] == "mismatch"
    assert got["test_file2.txt"] == "missing" and got["test_file5.txt"] == "untracked"


def test_transfer_audit(spark, tmp):
    src, dst = os.path.join(tmp, "src"), os.path.join(tmp, "dst")
    _make_tree(src, "n", 3)
    _make_tree(dst, "n", 2)
    with open(os.path.join(dst, "n", "test_file1.txt"), "w") as f:
        f.write("changed")
    with open(os.path.join(dst, "n", "extra.txt"), "w") as f:
        f.write("x")
    got = {r.location: r.status for r in FS.transfer_audit(
        FS.scan_artifacts(spark, src, node_level=False), FS.scan_artifacts(spark, dst, node_level=False)).collect()}
    assert got == {"n/test_file0.txt": "copied", "n/test_file1.txt": "mismatch", "n/test_file2.txt": "missing",
                   "n/extra.txt": "extra"}


def test_object_listing_whole_and_in_pages(spark, tmp):
    _make_tree(tmp, n=120)
    whole = sorted(r.key for r in FS.object_listing(spark, tmp).collect())
    assert len(whole) >= 120
    paged, last = [], None
    while page := [r.key for r in FS.object_listing(spark, tmp, page=50, start_after=last).collect()]:
        paged, last = paged + page, page[-1]
    assert paged == whole


def test_artifact_text_one_record_per_file(spark, tmp):
    _make_tree(tmp, n=4)
    got = {r.location: r.content for r in FS.artifact_text(spark, tmp).collect()}
    assert got == {f"test_file{i}.txt": f"test file {i}" for i in range(4)}


def test_custom_loader(spark, tmp):
    _make_tree(tmp, n=3)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmp)
    out = FS.custom_load(raw, lambda p, c: {"path": p, "upper": bytes(c).decode().upper()}, 
                         spark.createDataFrame([], "path string, upper string").schema)
    assert sorted(r.upper for r in out.collect()) == ["TEST FILE 0", "TEST FILE 1", "TEST FILE 2"]


def test_save_artifact_no_clobber(spark, tmp):
    df = spark.range(5)
    path = os.path.join(tmp, "out")
    rows = K.save_artifact(df, path, node_name="model_registry", run_id=3).collect()
    assert rows and all(r.state == "produced" and r.run_id == 3 and len(r.hash) == 64 for r in rows)
    with pytest.raises(Exception):
        K.save_artifact(df, path)
    assert K.save_artifact(df, path, overwrite=True).count() >= 1


def test_create_catalog_refuses_existing(spark, tmp):
    paths = K.create_catalog(spark, os.path.join(tmp, "cat"))
    assert spark.read.parquet(paths["artifacts"]).count() == 0
    with pytest.raises(Exception):
        K.create_catalog(spark, os.path.join(tmp, "cat"))


def test_saved_artifact_is_recorded_as_produced(spark, tmp):
    nodes = spark.createDataFrame([(1, "model_registry")], "id long, node_name string")
    catalog = spark.createDataFrame([], "id long, run_id long, node_id long, location string, state string, hash string")
    produced = K.save_artifact(spark.range(3), os.path.join(tmp, "model0"), node_name="model_registry", run_id=2)
    rows = K.insert_artifacts(catalog, nodes, produced).collect()
    assert rows and all(r.accepted and r.state == "produced" and r.run_id == 2 for r in rows)
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
