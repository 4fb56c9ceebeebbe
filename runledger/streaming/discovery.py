"""T-1 / T-2: continuous file discovery into the catalog, with a per-batch
count trigger.

Every micro-batch lists the tree in the executors, takes the files that no
earlier batch brought, stores that list under its batch and offset, and hashes the
files in chunks, dealt to tasks by their bytes.  All files count: empty ones,
hidden ones, names with blanks, files larger than a row may be.  The stream's
source gives one row whenever the tree has changed; its offset is a digest of
the folders' names, sizes and times, walked folder by folder, so the driver
holds one folder's entries at a time and never the tree.

Exactly-once sink: ``foreachBatch`` is at-least-once, so every batch writes
its own ``batch_id=k`` partition with dynamic partition overwrite, from the
stored list of batch k - a replayed batch hashes the same files and rewrites
the same folder instead of appending twice.  Files that were catalogued before
the stream started (a bulk scan) are removed by an anti join against that base
catalog.

Count trigger: a per-node state (files waiting, fired, cycle) is kept in a
small table (one row per node) written to two alternating folders, so batch k
reads what batch k-1 wrote and a replay of k rereads the same input.  A node
fires when ``min_new`` files wait; the run it starts takes them.  It stays
fired until that run ends (``end_runs``): further files wait for the next
cycle.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.utils import AnalysisException

from ..sources.files import _fs_and_path, _qualified, hash_listed, list_files

CATALOG_SCHEMA = "node_name string, location string, size long, hash string, batch_id long"
TRIGGER_SCHEMA = "node_name string, cycle long, num_new long, message string, batch_id long"
COUNT_SCHEMA = "node_name string, num_new long, fired boolean, cycle long, batch_id long"
ENDED_SCHEMA = "node_name string, cycle long"
LIST_SCHEMA = "path string, node_name string, location string, size long"


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:          # nothing written yet
        return spark.createDataFrame([], schema)


def _write_batch(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


class TreeChange(DataSource):
    """A streaming source of one row per change of the tree ``path``.  With
    ``bounded`` lists (option ``again``) a batch that left files behind makes
    another one due."""

    @classmethod
    def name(cls) -> str:
        return "runledger_tree"

    def schema(self) -> str:
        return "changed long"

    def streamReader(self, schema):
        return _ChangeReader(self.options["path"], self.options.get("again"))


class _ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str, again: str | None):
        self.root, self.again = root, again

    def initialOffset(self) -> dict:
        return {"tree": "", "again": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs as pafs
        filesystem, base = _fs_and_path(self.root)
        total, folders = 0, [base.rstrip("/")]
        while folders:
            for e in filesystem.get_file_info(pafs.FileSelector(folders.pop(), allow_not_found=True)):
                if e.type == pafs.FileType.Directory:
                    folders.append(e.path)
                else:                       # a sum of digests: the same in any order of folders
                    total += int.from_bytes(hashlib.blake2b(f"{e.path}|{e.size}|{e.mtime_ns}".encode(), digest_size=16).digest())
        left = 0
        if self.again:
            filesystem, path = _fs_and_path(self.again)
            left = filesystem.get_file_info(path).mtime_ns or 0
        return {"tree": f"{total % (1 << 128):032x}", "again": left}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(end["tree"])]

    def read(self, partition):
        yield (int(partition.value[:15], 16),)

    def commit(self, end: dict) -> None:
        pass


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"cannot rename {old}")


def _unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """``files`` that are not in ``seen`` (node_name, location); a file at the
    root has no node."""
    seen = seen.select(F.col("node_name").alias("_node"), F.col("location").alias("_location"))
    return files.join(seen, F.col("node_name").eqNullSafe(F.col("_node")) & (F.col("location") == F.col("_location")), "left_anti")


def discover(spark: SparkSession, root: str, catalog_path: str, checkpoint: str,
             max_files_per_trigger: int | None = None, trigger_path: str | None = None,
             min_new: int = 1, base_catalog: DataFrame | None = None,
             available_now: bool = True, processing_time: str | None = None):
    """Start the discovery stream; returns the ``StreamingQuery``.

    With ``available_now`` one batch takes all files that are there.  In a
    stream that goes on (``processing_time``) ``max_files_per_trigger`` bounds
    a batch to the oldest files (by time, then path); the next batches take
    the rest.  ``base_catalog``
    (``node_name, location``) holds what was catalogued before the stream; with
    ``trigger_path`` every batch also runs the count trigger."""
    spark.dataSource.register(TreeChange)
    tick = spark.readStream.format(TreeChange.name()).option("path", _qualified(spark, root))
    bounded = max_files_per_trigger is not None and bool(processing_time)
    again = _qualified(spark, f"{catalog_path}/_again")
    tick = (tick.option("again", again) if bounded else tick).load()
    base = None if base_catalog is None else base_catalog.select("node_name", "location")

    def batch_files(sp: SparkSession, batch_id: int, change: int) -> DataFrame:
        stored = f"{catalog_path}/_lists/{batch_id}-{change}"
        try:
            return sp.read.schema(LIST_SCHEMA).parquet(stored)          # a replay
        except AnalysisException:
            pass
        new = list_files(sp, root)
        if base is not None:
            new = _unseen(new, base)
        if batch_id:
            new = _unseen(new, _read_or_empty(sp, catalog_path, CATALOG_SCHEMA).where(F.col("batch_id") < batch_id))
        if bounded:
            new = new.orderBy("modified", "path").limit(max_files_per_trigger)
        # the list is written whole or not at all: the folder is named when it is done
        new.select("path", "node_name", "location", "size").write.mode("overwrite").parquet(stored + "-open")
        _rename(sp, stored + "-open", stored)
        listed = sp.read.schema(LIST_SCHEMA).parquet(stored)
        if bounded and listed.count() == max_files_per_trigger:
            filesystem, path = _fs_and_path(again)          # there may be more: another batch is due
            with filesystem.open_output_stream(path) as f:
                f.write(str(time.time_ns()).encode())
        return listed

    def per_batch(batch: DataFrame, batch_id: int):
        sp = batch.sparkSession
        change = batch.agg(F.max("changed")).first()[0]       # the batch's one row
        fresh = hash_listed(batch_files(sp, batch_id, change)).select("node_name", "location", "size", "hash")
        fresh = fresh.withColumn("batch_id", F.lit(batch_id).cast("long"))
        _write_batch(fresh, catalog_path)
        fresh = _read_or_empty(sp, catalog_path, CATALOG_SCHEMA).where((F.col("batch_id") == batch_id) & F.col("node_name").isNotNull())
        if trigger_path is not None:
            prev = _read_or_empty(sp, f"{trigger_path}/_counts/{(batch_id - 1) % 2}", COUNT_SCHEMA) \
                if batch_id > 0 else sp.createDataFrame([], COUNT_SCHEMA)
            add = fresh.groupBy("node_name").agg(F.count(F.lit(1)).alias("add"))
            over = read_ended(sp, trigger_path).distinct().withColumn("over", F.lit(True))
            known = prev.drop("batch_id").join(add, "node_name", "full").select(
                "node_name", (F.coalesce("num_new", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("num_new"),
                F.coalesce("fired", F.lit(False)).alias("fired"), F.coalesce("cycle", F.lit(0)).alias("cycle"))
            known = known.join(over, ["node_name", "cycle"], "left")
            held = F.col("fired") & F.col("over").isNull()
            counts = known.select("node_name", "num_new", held.alias("held"), "cycle",
                                  (~held & (F.col("num_new") >= min_new)).alias("now")).persist()
            counts.select("node_name", F.when(F.col("now"), 0).otherwise(F.col("num_new")).cast("long").alias("num_new"),
                          (F.col("held") | F.col("now")).alias("fired"),
                          F.when(F.col("now"), F.col("cycle") + 1).otherwise(F.col("cycle")).cast("long").alias("cycle"),
                          F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{trigger_path}/_counts/{batch_id % 2}")
            fires = (counts.where("now")
                     .select("node_name", (F.col("cycle") + 1).alias("cycle"), "num_new",
                             F.concat(F.lit("Detected "), F.col("num_new").cast("string"),
                                      F.lit(" new artifacts")).alias("message"),
                             F.lit(batch_id).cast("long").alias("batch_id")))
            _write_batch(fires, f"{trigger_path}/fired")
            counts.unpersist()

    w = tick.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_catalog(spark: SparkSession, catalog_path: str) -> DataFrame:
    return _read_or_empty(spark, catalog_path, CATALOG_SCHEMA)


def read_fired(spark: SparkSession, trigger_path: str) -> DataFrame:
    return _read_or_empty(spark, f"{trigger_path}/fired", TRIGGER_SCHEMA)


def read_counts(spark: SparkSession, trigger_path: str) -> DataFrame:
    """What the last batch left: files waiting per node, whether it has fired,
    its cycle.  Every batch writes all nodes."""
    both = [_read_or_empty(spark, f"{trigger_path}/_counts/{k}", COUNT_SCHEMA) for k in (0, 1)]
    return max(both, key=lambda df: df.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0])


def end_runs(ended: DataFrame, trigger_path: str) -> None:
    """Runs that ended: rows (node_name, cycle) of what ``read_fired`` gave.
    Their nodes are armed again from the stream's next batch on; ending a run
    twice, or one that is over, changes nothing."""
    ended.select("node_name", F.col("cycle").cast("long").alias("cycle")).write.mode("append").parquet(f"{trigger_path}/_ended")


def read_ended(spark: SparkSession, trigger_path: str) -> DataFrame:
    return _read_or_empty(spark, f"{trigger_path}/_ended", ENDED_SCHEMA)
