"""Helpers shared by the operators: stored intermediates, input checks,
per-worker state."""

from __future__ import annotations

import gc
import sys
import time
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import fresh_scratch


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back.  Cuts lineage: a lost executor costs no more than the tasks that
    read the table."""
    spark = df.sparkSession
    path = fresh_scratch(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table made by ``store`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    files = df.inputFiles()
    if not files or "/runledger/llm-" not in files[0]:
        return
    path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished jobs now: it does so once
    the driver has collected the jobs' plans, which takes two collections, the
    second after the listeners have let go of the last job.  For use after
    ``store``, whose table is all that later jobs read."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(name: str, make):
    """One object per Python worker, kept between tasks."""
    home = sys.modules.setdefault("_runledger_worker", types.ModuleType("_runledger_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
